"""Transport files: written by hand and by the sink, read as tables."""

import random
import struct

import numpy as np
import pandas as pd
import pytest

from cohortspark.sources import xport as X

HEAD = "HEADER RECORD*******{} HEADER RECORD!!!!!!!{}"


def ibm(x):
    """A hexadecimal double digit by digit."""
    if x is None:
        return b"." + bytes(7)
    if x == 0:
        return bytes(8)
    sign, x, power = (128 if x < 0 else 0), abs(x), 64
    while x >= 1:
        x, power = x / 16, power + 1
    while x < 1 / 16:
        x, power = x * 16, power - 1
    out = [sign | power]
    for _ in range(7):
        x *= 256
        out.append(int(x))
        x -= int(x)
    return bytes(out)


def table(name, fields, rows):
    """Records of one table; fields are (name, length), texts where the length is negative."""
    out = HEAD.format("MEMBER ", "000000000000000001600000000140").encode().ljust(80) + HEAD.format("DSCRPTR", "0" * 30).encode().ljust(80)
    out += (b"SAS     " + name.encode().ljust(8) + b"SASDATA 9.4     LINUX").ljust(64) + b"01JAN26:00:00:00" + b"01JAN26:00:00:00".ljust(80) + HEAD.format("NAMESTR", f"000000{len(fields):04d}" + "0" * 20).encode().ljust(80)
    at, names = 0, b""
    for i, (f, n) in enumerate(fields):
        names += struct.pack(">hhhh8s40s8shhh2s8shhi52s", 1 if n > 0 else 2, 0, abs(n), i + 1, f.encode().ljust(8), b" " * 40, b" " * 8, 0, 0, 0, b"  ", b" " * 8, 0, 0, at, bytes(52))
        at += abs(n)
    out += names + b" " * (-len(names) % 80) + HEAD.format("OBS    ", "0" * 30).encode().ljust(80)
    data = b"".join(b"".join(ibm(v)[:n] if n > 0 else v.encode("latin-1").ljust(-n) for (_, n), v in zip(fields, r)) for r in rows)
    return out + data + b" " * (-len(data) % 80)


def library(*tables):
    return HEAD.format("LIBRARY", "0" * 30).encode().ljust(80) + (b"SAS     SAS     SASLIB  9.4     LINUX".ljust(64) + b"01JAN26:00:00:00") + b"01JAN26:00:00:00".ljust(80) + b"".join(tables)


@pytest.fixture(scope="module")
def xp(spark):
    spark.dataSource.register(X.Xport)
    return spark


def test_numbers_both_ways():
    rng = random.Random(1)
    values = [1.0, -1.0, 0.1, 118.625, 1e-60, -3e60, 15.9999999, 16.0, 1 / 16, 2**-64] + [rng.uniform(-1, 1) * 10 ** rng.randint(-30, 30) for _ in range(300)]
    raw = np.frombuffer(b"".join(X.hexadecimal(v) for v in values), np.uint8).reshape(-1, 8)
    got, missing = X.numbers(raw)
    assert not missing.any() and np.allclose(got, values, rtol=1e-15, atol=0)
    assert all(X.hexadecimal(v) == ibm(v) for v in (1.0, 118.625, -0.15625, 16.0))
    with pytest.raises(ValueError):
        X.hexadecimal(1e80)


def test_short_numbers_and_missing_codes():
    raw = np.frombuffer(b"".join(ibm(v)[:4] for v in (1.5, -20.0)) + b".\0\0\0" + b"A\0\0\0" + b"\0\0\0\0" + b"A\x10\0\0", np.uint8).reshape(-1, 4)
    value, missing = X.numbers(raw)
    assert missing.tolist() == [False, False, True, True, False, False] and value[[0, 1, 4, 5]].tolist() == [1.5, -20.0, 0.0, 1.0]


def test_a_file_with_several_tables(xp, tmp_path):
    fields = [("SEQN", 8), ("WHO", -5), ("LBX", 4)]
    one = [(i, f"p{i}" if i % 3 else "", i / 4 if i % 5 else None) for i in range(100)]
    path = str(tmp_path / "A.xpt")
    with open(path, "wb") as f:
        f.write(library(table("ONE", fields, one), table("TWO", [("X", 8)], [(7.0,), (8.0,)])))
    assert [(m.name, m.width) for m in X.members(path)] == [("ONE", 17), ("TWO", 8)]
    got = sorted(map(tuple, xp.read.format("xport").option("path", path).load().collect()))
    assert got == [(float(i), w or None, v) for i, w, v in one]
    assert sorted(r.X for r in xp.read.format("xport").option("path", path).option("member", "TWO").load().collect()) == [7.0, 8.0]


def test_agrees_with_another_reader(tmp_path):
    rows = [(i, i * 1.25 - 30) for i in range(57)]
    path = str(tmp_path / "B.xpt")
    with open(path, "wb") as f:
        f.write(library(table("ONE", [("SEQN", 8), ("V", 8)], rows)))
    want = pd.read_sas(path, format="xport")
    m = X.members(path)[0]
    with open(path, "rb") as f:
        f.seek(m.start)
        raw = np.frombuffer(f.read(len(want) * m.width), np.uint8).reshape(-1, m.width)
    assert np.allclose(X.numbers(raw[:, 8:])[0], want["V"].to_numpy(), rtol=0, atol=1e-70)  # the other reader makes 5e-79 of zero


def test_partitions_by_rows(xp, tmp_path, monkeypatch):
    path = str(tmp_path / "C.xpt")
    with open(path, "wb") as f:
        f.write(library(table("ONE", [("SEQN", 8)], [(float(i),) for i in range(1003)])))
    monkeypatch.setattr(X, "SPLIT", 800)
    reader = X._Reader(path, None, X.Xport({"path": path}).schema())
    parts = reader.partitions()
    assert len(parts) == 11 and [p.start for p in parts[:2]] == [0, 100]
    assert sorted(v for p in parts for b in reader.read(p) for v in b.column(0).to_pylist()) == [float(i) for i in range(1003)]


def test_cycles(xp, tmp_path):
    for cycle, extra in (("G", []), ("H", [("NEW", 8)])):
        fields = [("SEQN", 8), ("LBXGH", 8), *extra]
        with open(tmp_path / f"GHB_{cycle}.xpt", "wb") as f:
            f.write(library(table("GHB", fields, [(k, v, 1.0)[: len(fields)] for k, v in ((62161, 5.5), (62162, None), (62163, 5.4e-79))])))
    got = X.read_cycles(xp, str(tmp_path), "GHB", ["G", "H", "I"])
    rows = sorted((r.SEQN, r.cycle, r.LBXGH, r.NEW) for r in got.collect())
    assert rows[:3] == [(62161, "G", 5.5, None), (62161, "H", 5.5, 1.0), (62162, "G", None, None)] and rows[-1] == (62163, "H", 0.0, 1.0)
    assert X.read_cycles(xp, str(tmp_path), "NONE", ["G"]).count() == 0


def test_a_sink_can_be_read_back(xp, tmp_path):
    path = str(tmp_path / "out")
    df = xp.range(500).selectExpr("cast(id as double) as SEQN", "if(id % 7 = 0, null, concat('n', id)) as WHO", "if(id % 9 = 0, null, id / 8 - 20) as V")
    df.repartition(3).write.format("xport").mode("append").option("path", path).save()
    assert len(X.files(path)) == 3
    back = xp.read.format("xport").option("path", path).load()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_other_files_are_refused(tmp_path):
    (tmp_path / "x.xpt").write_bytes(b"no" * 100)
    with pytest.raises(ValueError):
        X.members(str(tmp_path / "x.xpt"))
