"""Bootstrap resamples are exact multinomial draws."""

import hashlib

import numpy as np
import pytest
from enrichspark.functions import resample
from enrichspark.functions.resample import _sums, boot_means, share_of_block
import pyarrow as pa


def counts(n, block_rows, n_boot=3000, stream=77):
    """How often each row is drawn in each resample, read from indicator columns."""
    out = np.zeros((n_boot, n))
    for i in range(n):
        at = i // block_rows
        rows = range(at * block_rows, min(n, (at + 1) * block_rows))
        t = pa.table({"k": ["a"] * len(rows), "x": [float(r == i) for r in rows], "pos": list(rows), "n": [n] * len(rows), "block": [at] * len(rows), "stream": [stream] * len(rows)})
        out[:, i] = _sums(n_boot, block_rows)(t)["sums"][0].as_py()
    return out


@pytest.mark.parametrize("block_rows", [64, 5])
def test_counts_are_multinomial(block_rows):
    n = 17
    c = counts(n, block_rows)
    assert (c.sum(axis=1) == n).all()  # every resample draws n rows over all blocks
    assert np.abs(c.mean(axis=0) - 1).max() < 0.1
    cov = np.cov(c.T)
    off = cov[~np.eye(n, dtype=bool)]
    assert abs(np.diag(cov).mean() - (1 - 1 / n)) < 0.03 and abs(off.mean() + 1 / n) < 0.01


def test_blocks_agree_on_their_shares():
    boots = np.arange(1, 200)
    shares = [share_of_block(1000, b, 96, 5, boots) for b in range(11)]
    assert (sum(shares) == 1000).all() and abs(np.mean(shares[3]) - 96) < 3 and abs(np.mean(shares[10]) - 40) < 3


def test_means_follow_the_rows(spark):
    rows = [("a", i, float(i % 7)) for i in range(300)] + [("b", i, 2.0) for i in range(4)] + [("b", 9, None), ("c", 1, 5.0)]
    df = spark.createDataFrame(rows, "k string, gene long, v double").repartition(5)
    for block in (1 << 16, 50):
        got = boot_means(df, ["k"], "v", "gene", 400, 0, block).toPandas()
        assert got.groupby("k").size().to_dict() == {"a": 400, "b": 400, "c": 400} and got.boot.min() == 1
        by = got.groupby("k")["mean"]
        assert (got[got.k == "b"]["mean"] == 2).all() and (got[got.k == "c"]["mean"] == 5).all()
        x = np.array([i % 7 for i in range(300)])
        assert abs(by.mean()["a"] - x.mean()) < 0.03 and abs(by.std()["a"] - x.std() / 300 ** 0.5) < 0.02


def test_resamples_do_not_depend_on_blocks_or_tasks(spark, monkeypatch):
    """Every block size and every split over tasks gives the means of the plain rule."""
    n, n_boot = 300, 40
    df = spark.createDataFrame([("a", i, float(i * i % 11)) for i in range(n)], "k string, gene long, v double")
    stream = int(hashlib.md5(b"0|a").hexdigest()[:8], 16) % resample.MODULUS

    def mix(a, b):
        x = ((a ^ b) * 48271 + 11) % 2147483647
        x = ((x ^ (x >> 13)) * 69621 + b) % 2147483647
        return x ^ (x >> 16)
    want = []
    for boot in range(1, n_boot + 1):
        own = mix(stream, boot * 1664525 % 2147483647)
        want.append(sum((i * i % 11) for i in (mix(own, s * 22695477 % 2147483647) % n for s in range(n))) / n)
    for block, task, batch in ((1 << 21, 1 << 28, 1 << 18), (64, 1 << 28, 128), (7, 2000, 1 << 18)):
        monkeypatch.setattr(resample, "TASK_DRAWS", task)
        monkeypatch.setattr(resample, "BATCH", batch)
        got = boot_means(df, ["k"], "v", "gene", n_boot, 0, block).orderBy("boot").toPandas()
        assert got.boot.tolist() == list(range(1, n_boot + 1)) and np.allclose(got["mean"], want)
