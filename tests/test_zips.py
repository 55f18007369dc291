import io
import zipfile
import zlib

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from catalog import zipping
from plotscope.functions.text import clean_text
from plotscope.sources import rolls, zips

PLAIN = "A,B,C\n" + "".join(f"{i},x{i % 7},{i * i}\n" for i in range(300))
QUOTED = '"A","B","C"\r\n' + "".join(f'"{i}"," two\r\nlines, ""{i}"" ",""\r\n' for i in range(200))
MIXED = "A,B,C\n" + "".join(
    f"{i},5\" pipe {i},z\n\n   \n{i},\"a\"b\"c,\"\"\n{i},only two\n\"{i}\",\"x\ny\", \"lead,z\n".replace(', "lead,z', ',"lead"')
    for i in range(120)
)
TEXTS = {
    "plain": PLAIN, "quoted": QUOTED, "mixed": MIXED, "bom": "﻿" + QUOTED, "no last line end": PLAIN[:-1],
    "old line ends": PLAIN.replace("\n", "\r"), "blank lines first": "\n  \n" + PLAIN, "header only": "A,B,C\n",
    "header without line end": "A,B,C", "one row": "A,B,C\n1,2,3", "zero bytes": PLAIN.replace("x3", "x\0y"),
}


def put(path, text, member="t.csv"):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(member, text)


def read_parts(path, wanted, tasks):
    reader = zips.ZippedCsvReader([*wanted, zips.LABEL], [["y", path, None]], tasks)
    parts = sorted(reader.partitions(), key=lambda p: p.start)
    found = [[tuple(r.values()) for b in reader.read(p) for r in b.to_pylist()] for p in parts]
    return found


def as_pandas(text, wanted):
    """Cleaned rows as one read of the whole text by pandas gives them."""
    whole = pd.read_csv(io.BytesIO(text.encode()), usecols=wanted, dtype=str, keep_default_na=False)[wanted]
    values = [[None if pd.isna(v) else v.strip() or None for v in r] for r in whole.itertuples(index=False)]
    return [(*v, "y") for v in values]


@pytest.mark.parametrize("name", TEXTS)
@pytest.mark.parametrize("block", [7, 64, 1000, 1 << 20])
def test_parts_of_a_member_are_its_rows(tmp_path, monkeypatch, name, block):
    monkeypatch.setattr(zips, "_BLOCK_BYTES", block)
    monkeypatch.setattr(zips, "_SPLIT_BYTES", 500)
    path = f"{tmp_path}/t.zip"
    put(path, TEXTS[name])
    wanted = ["C", "A", "B"]
    whole = as_pandas(TEXTS[name], wanted)
    for tasks in (1, 4):
        found = read_parts(path, wanted, tasks)
        assert [r for part in found for r in part] == whole
        if len(TEXTS[name]) > 2000:
            assert len(found) == tasks and (block > 1000 or all(found))


def test_one_column_keeps_its_rows(tmp_path, monkeypatch):
    monkeypatch.setattr(zips, "_BLOCK_BYTES", 16)
    put(f"{tmp_path}/t.zip", 'A\n1\n\n  \n""\n2\n')
    assert read_parts(f"{tmp_path}/t.zip", ["A"], 1) == [[("1", "y"), (None, "y"), ("2", "y")]]


@pytest.mark.parametrize("text, error", [("", "No columns"), ("A,B\n1,2\n", "expected but not found"), ('A,C\n1,"2', "EOF")])
def test_faulty_members_are_errors(tmp_path, text, error):
    put(f"{tmp_path}/t.zip", text)
    with pytest.raises(ValueError, match=error):
        read_parts(f"{tmp_path}/t.zip", ["A", "C"], 1)


def test_large_members_are_several_partitions(spark, tmp_path, monkeypatch):
    """One task per member would grow with it."""
    monkeypatch.setattr(zips, "_SPLIT_BYTES", 50_000)
    monkeypatch.setattr(zips, "_BLOCK_BYTES", 10_000)
    put(f"{tmp_path}/a.zip", "P,Q\n" + "".join(f"{i}, {i % 3} \n" for i in range(100_000)))
    put(f"{tmp_path}/b.zip", "P,Q\n1,\n")
    df = rolls.read_zips(spark, {k: (f"{tmp_path}/{k}.zip", None) for k in "ab"}, ["P", "Q"])
    assert df.rdd.getNumPartitions() > 8
    assert df.filter("file_label = 'b'").collect() == [("1", None, "b")]
    got = df.filter("file_label = 'a'").agg(F.count("*"), F.count_distinct("P"), F.sum("P"), F.sum("Q"), F.max(F.length("Q"))).first()
    assert tuple(got) == (100_000, 100_000, sum(range(100_000)), sum(i % 3 for i in range(100_000)), 1)
    staged = rolls.staged(df, f"{tmp_path}/staged", "file_label")
    files = staged.groupBy(F.input_file_name()).agg(F.count_distinct("file_label").alias("n")).collect()
    assert len(files) > 8 and {r.n for r in files} == {1}


def test_reader_cleans_as_clean_text(spark, tmp_path):
    texts = [f"{c}a{c} b{c}" for c in map(chr, [*range(1, 0x3100), 0xFEFF, 0x1F600]) if c not in "\r\n"]
    texts += ["", " \t ", "　", "​"]
    put(f"{tmp_path}/t.zip", "A,B\n" + "".join(f'"{t.replace(chr(34), chr(34) * 2)}",{i}\n' for i, t in enumerate(texts)))
    got = rows(rolls.read_zips(spark, {"y": (f"{tmp_path}/t.zip", None)}, ["A", "B"]).selectExpr("int(B)", "A"), "B")
    df = spark.createDataFrame(list(enumerate(texts)), "B int, A string").select("B", clean_text(F.col("A")).alias("A"))
    assert got == rows(df, "B")


def test_zips_are_written_by_many_tasks(spark, tmp_path):
    """One task per file would grow with it: every task packs its rows, whatever their files."""
    data = [(f"p{i}", None if i % 5 == 0 else f' a,"{i}\n' if i % 7 == 0 else "", 2000 + i % 2 if i % 11 else None) for i in range(500)]
    df = spark.createDataFrame(data, "P string, Q string, year int").repartition(4)
    pieces = zipping._write_pieces(df, "year", f"{tmp_path}/pieces")
    assert sorted(p.label for p in pieces) == ["2000"] * 4 + ["2001"] * 4 + ["None"] * 4
    assert sorted(zipping.write_zips(df, "year", f"{tmp_path}/z", "{}F.zip", "m.csv")) == ["2000", "2001", "None"]
    assert sorted(p.name for p in (tmp_path / "z").iterdir()) == ["2000F.zip", "2001F.zip", "NoneF.zip"]
    for label in ("2000", "2001", "None"):
        with zipfile.ZipFile(f"{tmp_path}/z/{label}F.zip") as archive:
            assert archive.namelist() == ["m.csv"] and archive.testzip() is None
            found = pd.read_csv(archive.open("m.csv"), dtype=str, keep_default_na=False)
        want = sorted((p, q or "") for p, q, year in data if str(year) == label)
        assert list(found.columns) == ["P", "Q"] and sorted(found.itertuples(index=False, name=None)) == want


def test_zip_of_one_column_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), (None, 1), ("", 1)], "P string, y int")
    zipping.write_zips(df, "y", str(tmp_path), "{}.zip", "m.csv")
    got = rolls.read_zips(spark, {"1": (f"{tmp_path}/1.zip", "m.csv")}, ["P"])
    assert sorted(r.P or "" for r in got.collect()) == ["", "", "a"]


def test_crc_of_two_texts():
    texts = [b"", b"a", b"parcel,price\n" * 1000]
    assert all(zipping.crc_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b) for a in texts for b in texts)


def test_history_from_zips_is_the_history(spark, tiny, monkeypatch):
    """The raw rows are read once, so they are packed without being stored first."""
    from catalog import adapters as A, queries as Q

    written = []
    store = A.materialize
    monkeypatch.setattr(A, "materialize", lambda df: written.append(df.columns) or store(df))
    monkeypatch.setattr(A, "_tables", {})
    zipped = Q.sale_history_from_zips(spark, tiny)
    assert not written
    history = A.history(spark, tiny).select(*zipped.columns)
    assert zipped.count() == history.count() > 0 and zipped.exceptAll(history).isEmpty()
