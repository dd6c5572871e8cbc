import random
from contextlib import contextmanager

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dialogmill.operators.prompts import INFO_PROMPT, STYLE_PROMPT
from dialogmill.operators.templates import USER_ASSISTANT, render
from dialogmill.sources import files
from dialogmill.sources.csv_files import STYLE_COLUMNS, read_style_csv, read_style_records
from dialogmill.sources.listing import list_files, qualified

CSV = (
    "speaker,text,type\n"
    'Mara,"And why, ""pal""?",style\n'
    'Mara,"two\nlines",style\n'
    "Mara,Would you rather stay?,style \n"
    "Mara_info,:),info\n"
    "Mara_info,NA,info\n"
    "Mara_info,,info\n"
    "Mara_info,hello -éveré tail,info\n"
)
TEXTS = ['And why, "pal"?', "two\nlines", "Would you rather stay?", ":)", "NA", None, "hello -éveré tail"]


@contextmanager
def file_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "b.csv").write_text(CSV, encoding="utf-8")
    (tmp_path / "a b+c.txt").write_bytes("﻿  one\r\ntwo\rthree \n".encode())
    (tmp_path / "bad.txt").write_bytes(b"caf\xe9")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "c.CSV").write_text(CSV)
    (tmp_path / "d.md").write_text("x")
    return tmp_path


def test_style_csv_by_both_readers(spark, folder):
    path = str(folder / "b.csv")
    for rows in (
        read_style_csv(spark, [path]).orderBy("row_id"),
        read_style_csv(spark, [path], STYLE_COLUMNS).orderBy("row_id"),
        files.read_style_csv_unsplit(spark, [path]).orderBy("row_id"),
    ):
        got = rows.collect()
        assert [r.text for r in got] == TEXTS
        assert [r.type for r in got] == ["style", "style", "style ", "info", "info", "info", "info"]


def test_style_csv_with_another_header_fails(spark, tmp_path):
    (tmp_path / "x.csv").write_text("text,speaker,type\na,b,info\n")
    for read in (read_style_csv, files.read_style_csv_unsplit):
        with pytest.raises(Exception, match="(?i)header"):
            read(spark, [str(tmp_path / "x.csv")], STYLE_COLUMNS).collect()


def test_style_csv_finds_columns_by_name(spark, folder):
    (folder / "e.csv").write_text('type,more,text\ninfo,1,"x, y"\n\nstyle,2,z\n')
    rows = read_style_csv(spark, [str(folder / "b.csv"), str(folder / "e.csv")]).orderBy("row_id").collect()
    other = [(r.speaker, r.text, r.type) for r in rows if r.source_path.endswith("e.csv")]
    assert other == [(None, "x, y", "info"), (None, "z", "style")]
    assert [r.text for r in rows if r.source_path.endswith("b.csv")] == TEXTS


CSV_SHAPES = {
    "crlf": 'speaker,text,type\r\na,"x\ny",style\r\nb,"p\r\nq",info\r\nc,plain,"style"\r\n',
    "mixed": 'speaker,text,type\na,"x\ny",style\r\nb,"p\r\nq",info\nc,plain,"style"\r\nd,e,"info"\n',
    "crlf_header": 'speaker,text,type\r\na,"x\ny",style\nb,"p\r\nq",info\r\nc,plain,"style"\nd,e,info\r\n',
    "blank_lines": "speaker,text,type\n\na,b,style\n\n\nc,d,info",
    "blank_first": "\n\r\nspeaker,text,type\na,b,style\n",
    "no_last_newline": 'speaker,text,type\na,"",style\nc,d',
    "stray_quotes": 'speaker,text,type\na,5" pipe,style\nb,say "hi" now,info\nc,"q ""w"" e",info\nd,x "",info\n',
    "bom": "\ufeffspeaker,text,type\na,b,style\n",
    "quoted_newline_only": 'speaker,text,type\na,"\n\n",style\nb,"",info\nc,"x\n""\n,y",info\n',
}


@pytest.mark.parametrize("split", [9, 1_000_000])
def test_style_csv_like_pandas(spark, tmp_path, split):
    paths = []
    for name, body in CSV_SHAPES.items():
        (tmp_path / f"{name}.csv").write_bytes(body.encode())
        paths.append(str(tmp_path / f"{name}.csv"))
    with file_splits(spark, split):
        rows = read_style_csv(spark, paths).orderBy("source_path", "row_id").collect()
    for name, path in zip(CSV_SHAPES, paths):
        frame = pd.read_csv(path, keep_default_na=False, na_values=[""], dtype=str)
        want = [tuple(None if pd.isna(c) else c for c in r) for r in frame.itertuples(index=False)]
        got = [(r.speaker, r.text, r.type) for r in rows if r.source_path.endswith(f"/{name}.csv")]
        assert got == want, name


def test_malformed_field_leaves_other_rows_alone(spark, tmp_path):
    (tmp_path / "x.csv").write_text('speaker,text,type\na,"b"c,style\nd,e,info\n')
    rows = read_style_csv(spark, [str(tmp_path / "x.csv")]).orderBy("row_id").collect()
    assert [(r.speaker, r.type) for r in rows] == [("a", "style"), ("d", "info")]
    assert rows[1].text == "e"


@pytest.mark.parametrize("split", [97, 1_000_000])
def test_style_csv_split_over_tasks(spark, folder, split):
    """Blocks begin inside quoted fields, and records span several blocks."""
    rng = random.Random(5)
    pieces = ["word ", "a, b ", '"', "\n", "\r\n", "é", "\n\n"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 14))).strip("\r") or "x" for _ in range(120)]
    lines = [("s", t, "style") for t in texts]
    body = "".join(
        f's,"{t.replace(chr(34), chr(34) * 2)}",style{eol}' for t, eol in zip(texts, ["\n", "\r\n"] * 60)
    )
    (folder / "big.csv").write_bytes(("speaker,text,type\n" + body).encode())
    with file_splits(spark, split):
        rows = read_style_csv(spark, [str(folder / "big.csv"), str(folder / "b.csv")])
        got = rows.orderBy("source_path", "row_id").collect()
    big = [(r.speaker, r.text, r.type) for r in got if r.source_path.endswith("big.csv")]
    assert big == lines
    small = [r for r in got if r.source_path.endswith("b.csv") and "big" not in r.source_path]
    assert [r.text for r in small] == TEXTS and len({r.row_id for r in got}) == len(got)


def test_text_file_keeps_bom_and_normalises_newlines(spark, folder):
    rows = files.read_text_files(spark, [str(folder / "a b+c.txt")]).collect()
    assert [r.content for r in rows] == ["﻿  one\ntwo\nthree"]


def test_mixed_paths_in_the_given_order(spark, folder):
    names = ["d.md", "b.csv", "a b+c.txt", "c.CSV", "bad.txt", "empty.txt", "b.csv"]
    good, bad, skipped = files.read_conversations(spark, [str(folder / n) for n in names], "SYS")
    assert skipped == [str(folder / "d.md"), str(folder / "c.CSV")]
    rows = (
        good.withColumn("text", render(F.col("messages"), USER_ASSISTANT))
        .orderBy("source_no", "row_id")
        .collect()
    )
    assert [r.source_no for r in rows] == [1] * 6 + [2, 5] + [6] * 6
    assert rows[0].text == f'SYS\nUSER: {STYLE_PROMPT}\nASSISTANT: And why, "pal"?\n'
    assert rows[2].text == f"SYS\nUSER: {INFO_PROMPT}\nASSISTANT: Would you rather stay?\n"
    assert rows[5].text == f"SYS\nUSER: {INFO_PROMPT}\nASSISTANT: hello\n"
    body = "﻿  one\ntwo\nthree"
    assert rows[6].text == (
        f"You know the following information: {body}\n"
        f"USER: What do you know about this topic?\nASSISTANT: {body}\n"
    )
    assert rows[7].messages[2].content == ""
    reasons = sorted((r.source_no, r.reason) for r in bad.collect())
    assert reasons == [(1, "missing_text"), (4, "bad_encoding"), (6, "missing_text")]


def test_many_paths_are_numbered_like_few(spark, folder):
    paths = []
    for i in range(70):
        (folder / f"k{i}.txt").write_text(f"text {i}")
        paths.append(str(folder / f"k{i}.txt"))
    good, _, _ = files.read_conversations(spark, paths, "SYS")
    rows = good.orderBy("source_no").collect()
    assert [(r.source_no, r.messages[2].content) for r in rows] == [(i, f"text {i}") for i in range(70)]


def test_texts_from_rows(spark):
    rows = files.texts_from_rows(spark, [{"text": "a"}, {"text": "b"}])
    assert [r.text for r in rows.collect()] == ["a", "b"]
    assert files.texts_from_rows(spark, []).columns == ["text"]


def test_no_readable_path_gives_empty_tables(spark):
    good, bad, skipped = files.read_conversations(spark, ["x.md"], "SYS")
    assert skipped == ["x.md"]
    assert good.columns == ["source_no", "source_path", "row_id", "messages"]
    assert good.count() == 0 and bad.count() == 0


def test_folders_globs_and_empty_files_lose_no_row(spark, tmp_path):
    for name in ("one.txt", "two.txt"):
        (tmp_path / name).mkdir()
        for i in range(3):
            (tmp_path / name / f"part {i}.txt").write_text(f"{name} {i}" if i else "")
    for paths, places in (
        ([str(tmp_path / "one.txt"), str(tmp_path / "two.txt")], [0] * 3 + [1] * 3),
        ([str(tmp_path / "*.txt")], [0] * 6),
        ([f"file://{tmp_path}/one.txt/part*.txt", str(tmp_path / "two.txt")], [0] * 3 + [1] * 3),
    ):
        good, bad, _ = files.read_conversations(spark, paths, "SYS")
        rows = good.select("source_no", "source_path", "row_id").collect()
        assert sorted(r.source_no for r in rows) == places and bad.count() == 0
        assert len(set(map(tuple, rows))) == 6


def test_paths_are_named_as_a_listing_names_them():
    for path, name in (
        ("/a/b.txt", "hdfs://host:8020/a/b.txt"),
        ("hdfs:/a//b.txt/", "hdfs://host:8020/a/b.txt"),
        ("hdfs://other/a/./c/../b.txt", "hdfs://other/a/b.txt"),
        ("file:///a/b c.txt", "file:/a/b c.txt"),
        ("s3a://k/x.txt", "s3a://k/x.txt"),
        ("b.csv", "hdfs://host:8020/user/me/b.csv"),
    ):
        assert qualified([path], "hdfs://host:8020", "hdfs://host:8020/user/me") == [name], path


def test_globs_relative_and_nested_paths_give_each_row_once(spark, tmp_path, monkeypatch):
    for name in ("a", "b", "c", "d"):
        (tmp_path / f"{name}.csv").write_text(f"speaker,text,type\ns,{name},info\n")
    (tmp_path / "x" / "y.csv" / "z").mkdir(parents=True)
    (tmp_path / "x" / "a.csv").write_text("speaker,text,type\ns,xa,info\n")
    (tmp_path / "x" / "y.csv" / "z" / "deep").write_text("text\ndeep\n")
    working = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
    before = working.getWorkingDirectory()
    working.setWorkingDirectory(spark._jvm.org.apache.hadoop.fs.Path(str(tmp_path)))
    try:
        for paths, want in (
            (["a.csv", "x/a.csv"], [(0, "a"), (1, "xa")]),
            ([f"{tmp_path}/[a-c].csv"], [(0, "a"), (0, "b"), (0, "c")]),
            ([f"{tmp_path}/{{a,d}}.csv", "x/y.csv"], [(0, "a"), (0, "d"), (1, "deep")]),
            ([f"file://{tmp_path}/x/../a.csv", f"{tmp_path}/x/y.csv", f"{tmp_path}/?.csv"], [(0, "a"), (1, "deep"), (2, "a"), (2, "b"), (2, "c"), (2, "d")]),
        ):
            good, bad, _ = files.read_conversations(spark, paths, "SYS")
            assert sorted((r.source_no, r.messages[2].content) for r in good.collect()) == want, paths
            assert bad.count() == 0
    finally:
        working.setWorkingDirectory(before)


def test_a_long_list_of_paths_is_one_table(spark, tmp_path):
    paths = []
    for i in range(3000):
        (tmp_path / f"{i:04d}.txt").write_text(str(i))
        paths.append(f"{tmp_path}/{i:04d}.txt")
    rows = list_files(spark, paths[::-1]).collect()
    assert len(rows) == 3000
    assert all(r.source_path.endswith(f"/{2999 - r.source_no:04d}.txt") for r in rows)


def test_empty_files_at_any_depth(spark, tmp_path):
    (tmp_path / "k.txt" / "deep" / "er").mkdir(parents=True)
    (tmp_path / "k.txt" / "none").mkdir()
    for name in ("one.txt", "k.txt/two", "k.txt/deep/er/three", "k.txt/_SUCCESS"):
        (tmp_path / name).write_text("")
    (tmp_path / "k.txt" / "deep" / "four").write_text("full")
    good, bad, _ = files.read_conversations(spark, [f"{tmp_path}/k.txt", f"{tmp_path}/one.txt"], "SYS")
    found = sorted((r.source_no, r.source_path.rsplit("/", 1)[1], r.messages[2].content) for r in good.collect())
    assert found == [(0, "four", "full"), (0, "three", ""), (0, "two", ""), (1, "one.txt", "")]
    assert bad.count() == 0


def test_wide_headers_and_rejected_records(spark, tmp_path):
    wide = ",".join(f"c{i}" for i in range(17)) + ",type,text,speaker"
    cells = "," * 17
    (tmp_path / "wide.csv").write_bytes(
        f"{wide}\n{cells}info,one,s\n{cells}info,two,s,more\n{cells}info,three\n".encode() + cells.encode() + b"info,caf\xe9,s\n" + f"{cells}info,\ufffd,s\n".encode()
    )
    (tmp_path / "open.csv").write_text("speaker,text,type\na,b,info\nc,\"never closed,info\n" + "x,y,info\n" * 1000)
    (tmp_path / "last.csv").write_text('speaker,text,type\na,b,"info\nx,y,info\n')
    (tmp_path / "short.csv").write_text("text\nonly\ntwo,\nthree,x\n")
    paths = [f"{tmp_path}/{n}.csv" for n in ("wide", "open", "last", "short")]
    rows = read_style_records(spark, paths).orderBy("source_path", "row_id").collect()
    by_file = {n: [(r.reason, r.text if r.reason is None else r.record) for r in rows if r.source_path.endswith(f"/{n}.csv")] for n in ("wide", "open", "last", "short")}
    assert by_file["wide"][0] == (None, "one") and by_file["wide"][1] == ("too_many_fields", f"{cells}info,two,s,more")
    assert by_file["wide"][2] == (None, "three") and by_file["wide"][3][0] == "bad_encoding" and by_file["wide"][4] == (None, "\ufffd")
    assert by_file["open"][0] == (None, "b") and len(by_file["open"]) == 2
    assert by_file["open"][1][0] == "unclosed_quote" and by_file["open"][1][1].count("x,y,info") == 1000
    assert [r[0] for r in by_file["last"]] == ["unclosed_quote"]
    assert by_file["short"] == [(None, "only"), (None, "two"), ("too_many_fields", "three,x")]
    good, bad, _ = files.read_conversations(spark, paths, "SYS")
    assert good.count() + bad.count() == len(rows)
    assert {(r.source_no, r.reason) for r in bad.collect()} == {(0, "too_many_fields"), (0, "bad_encoding"), (1, "unclosed_quote"), (2, "unclosed_quote"), (3, "too_many_fields")}


def test_bytes_of_text_files_are_checked(spark, tmp_path):
    (tmp_path / "good.txt").write_bytes("a \ufffd b\r\n".encode())
    for name, data in (("cut.txt", b"caf\xc3"), ("half.txt", b"\xed\xa0\x80"), ("long.txt", b"\xc0\x80"), ("latin.txt", b"caf\xe9 x")):
        (tmp_path / name).write_bytes(data)
    good, bad, _ = files.read_conversations(spark, [f"{tmp_path}/*.txt"], "SYS")
    assert [r.messages[2].content for r in good.collect()] == ["a \ufffd b"]
    assert [r.reason for r in bad.collect()] == ["bad_encoding"] * 4
