"""Charset detection and CSV records over split files."""

import csv
import io
import os
import random

import pytest

from tabforge.sources import csv as C
from tabforge.sources import records
from tabforge.sources.charset import SEQUENCES, byte_lines, charset_votes, detect_encoding
from tabforge.sources.records import csv_records, ends_inside

TEXTS = {
    "utf-8": "name,note\nZoë,café au lait\n王,統計資料\n",
    "big5": "姓名,說明\n王小明,這是一個資料分析的例子\n陳大文,我們可以使用這個程式讀取檔案\n",
    "gb18030": "姓名,说明\n王小明,这是一个数据分析的例子\n陈大文,我们可以使用这个程序读取文件并且统计各种结果\n",
    "shift_jis": "名前,説明\n山田,これはデータの例です\n鈴木,ファイルを読みます\n",
    "euc_jp": "名前,説明\n山田,これはデータの例です\n鈴木,ファイルを読みます\n",
    "euc_kr": "이름,설명\n김철수,이것은 데이터 분석의 예입니다\n이영희,파일을 읽을 수 있습니다\n",
    "cp1252": "name,note\nZoë,“café” – très bien\nJürgen,schöne Grüße\n",
    "utf-16": "name,note\nann,plain\nbob,x\n",
}


@pytest.mark.parametrize("charset", TEXTS)
def test_each_charset_is_told_and_read(spark, tmp_dir, charset):
    path = os.path.join(tmp_dir, f"charset-{charset}.csv")
    with open(path, "w", encoding=charset, newline="") as f:
        f.write(TEXTS[charset])
    assert detect_encoding(spark, path) == charset
    want = list(csv.reader(io.StringIO(TEXTS[charset])))
    got = C.read_table(spark, path)
    assert got.columns == want[0]
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want[1:])


def test_plain_and_empty_files_are_utf8(spark, tmp_dir):
    for name, body in (("ascii", b"a,b\n1,2\n"), ("nothing", b""), ("mark", b"\xef\xbb\xbfa,b\n1,2\n")):
        path = os.path.join(tmp_dir, f"{name}.csv")
        with open(path, "wb") as f:
            f.write(body)
        assert detect_encoding(spark, path) == "utf-8"


def plain_invalid(raw: bytes, charset: str) -> int:
    """Bytes outside well-formed sequences, one sequence at a time."""
    import re
    valid = re.compile(b"[\\x00-\\x7f]|" + SEQUENCES[charset][0].encode("latin-1"), re.S)
    at = bad = 0
    while at < len(raw):
        m = valid.match(raw, at)
        bad += m is None
        at = m.end() if m else at + 1
    return bad


def test_counts_of_malformed_bytes(spark, tmp_dir):
    rng = random.Random(5)
    raw = bytes(rng.choice((rng.randrange(256), 10, 0xE9, 0xA4, 0x41)) for _ in range(4000))
    path = os.path.join(tmp_dir, "noise.bin")
    with open(path, "wb") as f:
        f.write(raw)
    for r in charset_votes(byte_lines(spark, path)).collect():
        assert r["n_invalid"] == plain_invalid(raw, r["candidate"])
        assert r["n_high"] == sum(b > 127 for b in raw) and r["n_bytes"] == len(raw) - raw.count(10)


def test_line_states():
    for line, out_to, in_to in ((b'a,b', 0, 1), (b'a,"b', 1, 0), (b'5" pipe,x', 0, 0), (b'"a""b",c', 0, 0),
                                (b'a,"x"y"z,"q', 1, 1), (b'x",y', 0, 0), (b'""', 0, 1), (b'"', 1, 0)):
        assert (ends_inside(line, b",", False), ends_inside(line, b",", True)) == (bool(out_to), bool(in_to)), line


@pytest.fixture
def tiny_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def random_rows(seed: int, n: int) -> list[list[str]]:
    rng = random.Random(seed)
    cells = ["x", "", 'say "hi"', "a,b", "line\nbreak", "two\n\nbreaks", "é" * 40, "l\n" * 350, '"', '",\n"', 'pipe 5" x']
    return [[str(i), rng.choice(cells), rng.choice(cells)] for i in range(n)]


def test_records_of_split_files_match_a_whole_read(spark, tmp_dir, tiny_splits):
    folder = os.path.join(tmp_dir, "split-csv")
    os.makedirs(folder)
    want = []
    for part in range(3):
        rows = random_rows(part, 14)
        with open(os.path.join(folder, f"p{part}.csv"), "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator="\r\n" if part == 1 else "\n")
            w.writerow(["id", "first", "sec\nond"])
            w.writerows(rows)
            f.write("\n")
        want += [[f"{part}"] + r for r in rows]
    assert byte_lines(spark, folder).select("file", "block").distinct().count() > 10
    recs = csv_records(spark, folder).collect()
    assert sum(r["header"] for r in recs) == 3
    got = [next(csv.reader(io.StringIO(r["record"], newline=""))) for r in recs if not r["header"]]
    assert sorted(got) == sorted(r[1:] for r in want)
    back = C.read_table(spark, folder, sep=",", infer=False)
    assert back.columns == ["id", "first", "sec\nond"]
    null = lambda v: None if v in C.NA_TOKENS else v
    assert sorted((tuple(r) for r in back.collect()), key=repr) == sorted((tuple(null(v) for v in r[1:]) for r in want), key=repr)


@pytest.mark.parametrize("broadcast", [100, -1])
def test_literal_quotes_and_a_quote_never_closed(spark, tmp_dir, tiny_splits, monkeypatch, broadcast):
    monkeypatch.setattr(records, "BROADCAST_SPLITS", broadcast)
    path = os.path.join(tmp_dir, "quotes.csv")
    with open(path, "w", newline="") as f:
        f.write('a,b\n5" pipe,1\n' + "x,2\n" * 100 + 'y,"open\n' + "z,3\n" * 200)
    recs = [r["record"] for r in csv_records(spark, path).collect()]
    assert len(recs) == 103 and '5" pipe,1' in recs
    assert max(recs, key=len) == 'y,"open\n' + "z,3\n" * 199 + "z,3"


def test_records_are_decoded_as_by_python(spark):
    from tabforge.sources import records
    raw = [bytes(range(256)), b"plain", "café € \U0001f600".encode(), b"\xe2\x82 x\xf0\x9f\x98", b"\xc0\xaf\xed\xa0\x80", b""]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "i int, b binary")
    for encoding in ("utf-8", "iso-8859-1", "cp1252", "big5"):
        col = records.decoded("b", encoding)
        assert ("text(" in str(col)) == (encoding == "big5")
        got = {r.i: r.t for r in df.select("i", col.alias("t")).collect()}
        assert got == {i: b.decode(encoding, "replace") for i, b in enumerate(raw)}
