"""Quoted line breaks: many splits against Spark's own multi-line reader."""

import os
import random

import pytest

from shoppulse.sources import read_review_dir, read_reviews
from shoppulse.sources.quoted import quoted_records, read_quoted

PIECES = ["a", "bc", " ", '"', '""', "\\", '\\"', ",", "\n", "\r\n", "好评", "word", '"q"', ',"', '",', '\n"', '"\n']


@pytest.fixture()
def split_bytes(spark):
    """Sets the size of a split, and puts the old one back."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def to(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield to
    for k, v in old.items():
        spark.conf.set(k, v)


def plain(spark, path, header, names=None, escape="\\"):
    r = spark.read.option("header", header).option("multiLine", True).option("escape", escape)
    return r.schema(", ".join(f"`{n}` string" for n in names)).csv(path) if names else r.csv(path)


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def write(path, text, **kw):
    with open(path, "w", encoding="utf-8", newline="", **kw) as f:
        f.write(text)


def test_one_large_file_is_read_by_many_tasks(spark, tmpdir_path, split_bytes):
    rng = random.Random(1)
    body = []
    for i in range(3000):
        lines = rng.choice([1, 1, 2, 5])
        quoted = "\n".join(f"line {k} of {i}, \\\"said\\\" so" + "," * (k % 2) for k in range(lines))
        body.append(f'"{quoted}",{i}' if rng.random() < 0.8 else f"plain {i},{i}")
    p = os.path.join(tmpdir_path, "big.csv")
    write(p, "comments,n\n" + "\n".join(body) + "\n")
    want = rows(plain(spark, p, True))
    assert len(want) == 3000
    split_bytes(8192)
    got = read_reviews(spark, p, multi_line=True)
    assert got.columns == ["comments", "n"]
    assert spark.read.text(p).rdd.getNumPartitions() > 10
    assert rows(got) == want


def test_record_longer_than_a_split(spark, tmpdir_path, split_bytes):
    """A record over many splits, a header that spans lines, blank lines and \\r\\n."""
    p = os.path.join(tmpdir_path, "long.csv")
    record = "\r\n".join(f"row {i} of one record" for i in range(400))
    write(p, f'\r\n"the\r\ntext",k\r\n\r\n"{record}",1\r\nshort,2\r\n\r\n"x\r\ny",3\r\n')
    split_bytes(512)
    got = quoted_records(spark, p)
    assert sorted(len(r.record) for r in got.collect()) == [7, 7, len(record.replace("\r", "")) + 4]
    assert sorted(r.record for r in got.collect())[-1] == "short,2"
    split_bytes(1 << 20)
    assert sorted(r.record for r in got.collect()) == sorted(r.record for r in quoted_records(spark, p).collect())


def by_character(text: str, escape: str) -> list[str]:
    """The records of a text, one character at a time."""
    text = text.replace("\r\n", "\n")
    out, record, k, fresh, quoted = [], "", 0, True, False
    while k < len(text):
        c, following = text[k], text[k + 1:k + 2]
        if quoted and c == escape and following == '"' or quoted and c == escape == "\\" and following == "\\":
            record, k = record + c + following, k + 2
            continue
        if quoted:
            quoted = c != '"'
        elif c == "\n":
            out, record, fresh, k = out + [record], "", True, k + 1
            continue
        else:
            quoted, fresh = fresh and c == '"', c == ","
        record, k = record + c, k + 1
    return [r for r in out + [record.removesuffix("\n")] if r]


@pytest.mark.parametrize("escape", ["\\", '"'])
def test_random_text_equals_a_reader_by_character(spark, tmpdir_path, split_bytes, escape):
    """Stray quotes, escapes, separators and line ends at random, in splits of 64 bytes."""
    rng = random.Random(7)
    want = {}
    for i in range(24):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(400))) + rng.choice(["", "\n"])
        write(os.path.join(tmpdir_path, f"{i}.csv"), text)
        want[f"{i}.csv"] = sorted(by_character(text, escape))
    split_bytes(64)
    got = quoted_records(spark, os.path.join(tmpdir_path, "*.csv"), header=False, escape=escape).collect()
    for name, records in want.items():
        assert sorted(r.record for r in got if r.file.endswith("/" + name)) == records


@pytest.mark.parametrize("escape", ["\\", '"'])
def test_random_tables_equal_the_plain_reader(spark, tmpdir_path, split_bytes, escape):
    """Quoted fields of any text and open fields with quotes inside, with both kinds of line ends."""
    rng = random.Random(11)

    def field():
        raw = "".join(rng.choice(["a", "bc ", '"', ",", "\n", "好评", "\\"]) for _ in range(rng.randrange(1, 12)))
        if rng.random() < 0.5:
            return "open " + raw.replace(",", "").replace("\n", "").replace("\\", "")
        if escape == '"':
            return '"' + raw.replace('"', '""') + '"'
        return '"' + raw.replace("\\", "\\\\").replace('"', '\\"') + '"'

    names = ["a", "b", "c"]
    for i in range(6):
        end = "\r\n" if i % 2 else "\n"
        text = "\n".join(",".join(field() for _ in names) for _ in range(40))
        p = os.path.join(tmpdir_path, f"{i}.csv")
        write(p, (text + "\n").replace("\n", end))
        split_bytes(1 << 20)
        want = rows(plain(spark, p, False, names, escape))
        assert len(want) == 40
        split_bytes(256)
        assert rows(read_quoted(spark, p, False, names, escape=escape).drop("_file")) == want


def test_review_files_with_line_breaks(spark, tmpdir_path, split_bytes):
    write(os.path.join(tmpdir_path, "12po.csv"), '﻿comments\n"good\nand cheap"\nfine\n')
    write(os.path.join(tmpdir_path, "34ne.csv"), '﻿comments\n"bad, ""very"" bad\n"\n')
    write(os.path.join(tmpdir_path, "56ne.csv"), "")
    split_bytes(16)
    got = read_review_dir(spark, os.path.join(tmpdir_path, "*.csv"), multi_line=True, escape='"')
    assert rows(got) == [("12", "po", "fine"), ("12", "po", "good\nand cheap"), ("34", "ne", 'bad, "very" bad\n')]
    assert rows(read_reviews(spark, os.path.join(tmpdir_path, "12po.csv"), header=False, multi_line=True)) == [
        ("comments",), ("fine",), ("good\nand cheap",)]
