import csv
import io
import random

import pytest

from recon.sources.delimited import LOSSY, csv_tables, quoted_after, records


def slow(raw):
    for encoding in ("utf-8-sig", "cp949"):
        try:
            return encoding, list(csv.reader(io.StringIO(raw.decode(encoding), newline="")))
        except UnicodeDecodeError:
            continue
    return LOSSY, list(csv.reader(io.StringIO(raw.decode("utf-8", "replace"), newline="")))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rng, folder, out = random.Random(7), tmp_path_factory.mktemp("csv"), {}
    cells = ["", "a", "가나", '"x"', '"두\n줄"', '"a, b"', '"with ""quotes"""', 'in"ch', '"open" tail', " ", "1,5", '"\n\n"', '"long\n' + "line\n" * 40 + '"']
    for i in range(14):
        ends = rng.choice(["\n", "\r\n"])
        rows = ["name,,amount, note"] + [",".join(rng.choices(cells, k=rng.choice([1, 3, 4, 6]))) for _ in range(rng.choice([0, 3, 60]))] + ["", ",,", '"never closed\nto the end'] * (i % 4 == 0)
        raw = ends.join(rows).encode("cp949" if i % 3 == 0 else "utf-8")
        raw = b"\xef\xbb\xbf" + raw if i % 3 == 1 else raw + b"\xff\xfe\x00\x80\n" * (i == 5)
        (folder / f"f{i}.csv").write_bytes(raw)
        out[f"f{i}.csv"] = raw
    (folder / "empty.csv").write_bytes(b"")
    (folder / "other.txt").write_bytes(b"a,b")
    return str(folder), out


@pytest.mark.parametrize("piece", ["64m", "97b"])
def test_records_are_those_of_whole_files_however_they_are_cut(spark, files, piece):
    folder, raws = files
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", piece)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got: dict = {}
        for r in records(spark, folder).collect():
            got.setdefault(r.path.rsplit("/", 1)[1], []).append(((r.block, r.seq, r.sub), list(r["values"]), r.encoding))
        for name, raw in raws.items():
            encoding, want = slow(raw)
            rows = sorted(got[name])
            assert [v for _, v, _ in rows if v] == [v for v in want if v], name
            assert {e for *_, e in rows} == {encoding}
        assert "empty.csv" not in got and "other.txt" not in got
        if piece == "97b":
            assert len({at[0] for at, *_ in got["f2.csv"] + got["f1.csv"] + got["f4.csv"]}) > 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_tables_have_named_columns_and_no_blank_rows(spark, files):
    folder, raws = files
    rows = csv_tables(spark, folder).collect()
    for name, raw in raws.items():
        want = [[r[k] if k < len(r) else None for k in (0, 2, 3)] for r in slow(raw)[1][1:] if any(c.strip() for c in r)]
        got = sorted(((r.block, r.seq, r.sub), r.header, list(r["values"])) for r in rows if r.path.endswith("/" + name))
        assert [v for *_, v in got] == want and all(h == ["name", "amount", "note"] for _, h, _ in got)


def test_lines_end_inside_a_field_as_the_csv_module_says():
    rng = random.Random(2)
    for _ in range(3000):
        line = "".join(rng.choices('a",\r ', weights=[3, 4, 3, 1, 1], k=rng.randrange(9)))
        for inside in (False, True):
            text = ('"' if inside else "") + line
            open_ = any("\x00end" in c and "\n" in c for r in csv.reader(io.StringIO(text + "\n\x00end", newline="")) for c in r)
            assert quoted_after(line.encode(), inside) == open_, (line, inside)


def test_quotes_are_followed_byte_by_byte():
    """F8: what stands between quotes is passed at once, with the answers of one step a byte."""
    import itertools

    def slow(line, inside):
        state = "quoted" if inside else "begin"
        for c in line:
            if state == "quoted":
                state = "closing" if c == 34 else state
            elif c == 34 and state in ("begin", "closing"):
                state = "quoted"
            else:
                state = "begin" if c in b",\r" else "plain"
        return state == "quoted"

    for n in range(7):
        for line in map(bytes, itertools.product(b'",\rx', repeat=n)):
            assert all(quoted_after(line, k) == slow(line, k) for k in (False, True))
