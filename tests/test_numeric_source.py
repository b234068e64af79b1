import numpy as np
import pytest

from marginwise.sources import numeric


@pytest.fixture(scope="module")
def known(spark):
    numeric.register(spark)
    return spark


def load(spark, path, **options):
    return spark.read.format("numbers").options(**options).load(str(path))


@pytest.mark.parametrize("range_bytes", [1, 7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("ending", ["\n", ""])
def test_every_line_once(known, tmp_path, range_bytes, ending):
    rng = np.random.default_rng(range_bytes)
    for name in ("a.csv", "b.csv"):
        lines = [",".join(repr(float(v)) for v in rng.normal(size=rng.integers(1, 5)).round(3)) for _ in range(12)]
        lines[3:3] = ["", "  "]
        (tmp_path / name).write_text("\n".join(lines) + ending)
    (tmp_path / "_SUCCESS").write_text("x")
    (tmp_path / ".hidden").write_text("y")
    want = []
    for name in ("a.csv", "b.csv"):
        at = 0
        for line in (tmp_path / name).read_bytes().split(b"\n"):
            if line.strip():
                want.append((name, at, [float(c) for c in line.split(b",")]))
            at += len(line) + 1
    found = load(known, tmp_path, range_bytes=str(range_bytes)).collect()
    got = sorted((r["file"].rsplit("/", 1)[1], r["at"], r["x"]) for r in found)
    assert got == sorted(want)


def test_cells(known, tmp_path):
    (tmp_path / "t.txt").write_bytes(b"1; 2.5 ;;-3e2\r\n nan;inf\r\n")
    first, second = load(known, tmp_path / "t.txt", sep=";").orderBy("at").select("x").collect()
    assert first["x"] == [1.0, 2.5, None, -300.0] and np.isnan(second["x"][0]) and second["x"][1] == np.inf
    (tmp_path / "bad.txt").write_text("1,2\n3,four\n")
    with pytest.raises(Exception, match="byte 4: could not convert"):
        load(known, tmp_path / "bad.txt").collect()
    (tmp_path / "empty.txt").write_text("")
    assert load(known, tmp_path / "empty.txt").collect() == []
