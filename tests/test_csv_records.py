"""CSV records with quoted line breaks, whatever the splits."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from kestrel.sources import csv_records as R


@pytest.fixture
def tiny_splits(spark):
    """Cut files into splits of the size asked for."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k, None) for k in keys}

    def cut(n):
        spark.conf.set(keys[0], str(n))
        spark.conf.set(keys[1], "0")
    yield cut
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def expected(text):
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


def read(spark, path, **options):
    rows = R.records(spark, str(path), **options).orderBy("file_path", "record_no").collect()
    out = {}
    for r in rows:
        out.setdefault(r.file_path.rsplit("/", 1)[-1], []).append((r.record_no, r.cells))
    return {f: [c for n, c in v] for f, v in out.items() if [n for n, _ in v] == list(range(1, len(v) + 1))}


def sample(seed, rows=400):
    rng = random.Random(seed)
    cell = lambda: rng.choice(["", "a", "5", "two\nlines", "x\r\ny", 'say "hi"', '"', "a,b", '",\n"', "\n\n\n", '12" wide', "é漢", " pad ", '""'])
    out = io.StringIO()
    w = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
    w.writerow(["c1", "c 2", "c3"])
    for _ in range(rows):
        w.writerow([cell() for _ in range(rng.choice([3, 3, 3, 2, 4]))])
        if rng.random() < 0.1:
            out.write(rng.choice(["\n", "\r\n", '12" pipe,3" x,4\n', 'a,"b"c"d,e\n']))
    return out.getvalue()


@pytest.mark.parametrize("size", [700, 4000, 1 << 20])
def test_records_are_those_of_the_csv_module(spark, tmp_path, tiny_splits, size):
    tiny_splits(size)
    texts = {f"f{k}.csv": sample(k) for k in range(2)} | {"none.csv": "", "head.csv": "a,b", "open.csv": 'a,b\n1,"x\ny\nz'}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = read(spark, tmp_path)
    assert got == {n: expected(t) for n, t in texts.items() if t}


def test_the_probe(spark, tmp_path):
    (tmp_path / "p.csv").write_text('sku,name,n\nA,"two\nlines",5\nB,plain,6\n')
    rows = R.table_of(R.records(spark, str(tmp_path))).orderBy("_row").collect()
    assert [(r._row, r.sku, r.name, r.n) for r in rows] == [(1, "A", "two\nlines", "5"), (2, "B", "plain", "6")]


def test_states_are_joined_by_shuffle_beyond_the_bound(spark, tmp_path, tiny_splits, monkeypatch):
    tiny_splits(2000)
    monkeypatch.setattr(R, "BROADCAST_SPLITS", 3)
    text = sample(9)
    (tmp_path / "f.csv").write_bytes(text.encode())
    assert read(spark, tmp_path) == {"f.csv": expected(text)}


def test_encoding_is_found_per_file(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("a\nSào\n".encode("latin-1"))
    (tmp_path / "utf.csv").write_bytes("a\nSào\n".encode())
    assert read(spark, tmp_path) == {"latin.csv": [["a"], ["Sào"]], "utf.csv": [["a"], ["Sào"]]}


def test_a_quote_that_never_closes_is_refused(spark, tmp_path, tiny_splits, monkeypatch):
    tiny_splits(2000)
    monkeypatch.setattr(R, "MAX_CELL_BYTES", 5000)
    (tmp_path / "f.csv").write_text('a,b\n1,"x\n' + "line,line\n" * 2000)
    with pytest.raises(R.UnclosedQuote):
        R.records(spark, str(tmp_path))


def test_digest_of_content(spark, tmp_path, tiny_splits):
    """Equal content has one digest whatever the splits; swapped lines, a changed byte or a last line break change it."""
    text = sample(1)
    lines = text.split("\n")
    files = {"a": text, "b": text, "swapped": "\n".join([lines[0], lines[2], lines[1], *lines[3:]]), "changed": text[:-3] + "#" + text[-2:],
             "longer": text + "\n", "shorter": text.rstrip("\r\n")}
    for name, t in files.items():
        (tmp_path / name).write_bytes(t.encode())
    seen = set()
    for size in (1500, 1 << 20):
        tiny_splits(size)
        got = {r.file_path.rsplit("/", 1)[-1]: r.file_hash for r in R.digests(R.splits(spark, str(tmp_path))).collect()}
        assert got["a"] == got["b"] and len(set(got.values())) == len(files) - 1
        seen.add(tuple(sorted(got.items())))
    assert len(seen) == 1


def test_any_cut_at_line_ends_gives_the_same(spark):
    """The two passes over splits of a few lines each, states combined one by one."""
    import pyarrow as pa
    rng = random.Random(12)
    for seed in range(40):
        text = sample(seed, 30)
        lines = text.encode().split(b"\n")
        lines = lines[:-1] if not lines[-1] else lines
        cuts = sorted(rng.sample(range(1, len(lines)), rng.randint(1, 25)))
        inside, before, rows, open_ = False, 0, {}, {}
        whole = R._Split("f", 0, len(text))
        whole.add(pa.array(lines, pa.binary()))
        value = 0
        for a, b in zip([0, *cuts], [*cuts, len(lines)]):
            part = pa.array(lines[a:b], pa.binary())
            split, reader = R._Split("f", a, len(text)), R._Reader("f", a, inside, before, "utf-8")
            split.add(part.slice(0, (b - a) // 2))
            split.add(part.slice((b - a) // 2))
            for batch in [*reader.read(part.slice(0, (b - a) // 2)), *reader.read(part.slice((b - a) // 2)), *reader.rest()]:
                for r in batch.to_pylist():
                    if r["fragment"] is None:
                        rows[r["record_no"]] = r["cells"]
                    else:
                        open_.setdefault(r["record_no"], []).append(r["fragment"])
            value = (value * pow(R.PLACE, split.n, R.PRIME) + split.digest) % R.PRIME
            before += split.records[inside]
            inside = split.end[inside]
            assert reader.inside == inside and reader.number == before
        rows |= {n: next(csv.reader([b"\n".join(f).decode()])) for n, f in open_.items()}
        assert [rows[n] for n in sorted(rows)] == expected(text) and value == whole.digest
        assert sorted(rows) == list(range(1, len(rows) + 1))


def test_the_state_machine():
    for line, outside, inside in ((b"a,b", False, True), (b'"a', True, False), (b'a,"b', True, False), (b'12" x', False, False),
                                  (b'"a""b', True, False), (b'""', False, True), (b'x"",y', False, True), (b'a,"b",c', False, False), (b'"a"b"c', False, False)):
        assert (R.ends_inside(line, False), R.ends_inside(line, True)) == (outside, inside), line


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_records_are_written_only_where_one_crosses_a_border(spark, tmp_path, tiny_splits, monkeypatch, size):
    tiny_splits(size)
    spark.conf.set("spark.sql.files.openCostInBytes", str(size))  # small files aren't cut finer
    text = '\n"k ""1""","v\n2"\n' + "".join(f'{k},"a{k}\nb,é"\n' for k in range(40))
    (tmp_path / "a.csv").write_bytes(text.encode())
    (tmp_path / "b.csv").write_bytes("k,v\n40,é\n".encode("latin-1"))
    names, write = [], R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, name: (names.append(name), write(df, name))[1])
    rows = R.rows_of(spark, str(tmp_path))
    assert rows.columns == ["_file", "_row", 'k "1"', "v\n2"]
    got = [tuple(r)[1:] for r in rows.orderBy("_file", "_row").collect()]
    assert got == [(k + 1, str(k), f"a{k}\nb,é") for k in range(40)] + [(1, "40", "é")]
    assert ("csv-records" in names) == (size == 40)
