import gzip
import hashlib
import os

import pytest

from weftline.llm import warc


def files(path):
    return {f: hashlib.sha256(open(os.path.join(path, f), "rb").read()).hexdigest() for f in sorted(os.listdir(path)) if f.endswith(".gz")}


def test_round_trip_and_determinism(spark, tmp_path):
    big, big2 = "<p>é" * 400, "<b>" * 500
    rows = [(k, f"http://x/{k}", t) for k, t in [(5, big), (9, big), (2, big), (1, "small"), (3, "small"), (4, None), (7, ""), (11, big2), (12, "z" * 200_000)]] + [(None, "u\r\nv", big2), (9, "http://x/9", big), (-4, None, "neg")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    manifest = [r.asDict() for r in warc.write_warc(table.repartition(5), a, shard_bytes=3000, roll_bytes=2000).collect()]
    warc.write_warc(table.repartition(2), b, shard_bytes=3000, roll_bytes=2000)
    assert files(f"{tmp_path}/a") == files(f"{tmp_path}/b") and len(manifest) > 2 and set(files(f"{tmp_path}/a")) == {m["name"] for m in manifest}
    with pytest.raises(FileExistsError):
        warc.write_warc(table, a)
    for m in manifest:
        raw = open(f"{tmp_path}/a/{m['name']}", "rb").read()
        assert len(raw) == m["bytes"] and hashlib.sha256(raw).hexdigest() == m["sha256"] and (m["records"] == 1 or m["bytes"] <= 2000)
        assert sum(1 for _ in warc.parse(gzip.GzipFile(f"{tmp_path}/a/{m['name']}"))) == m["records"] + 1
    got = warc.read_warc(spark, a).collect()
    assert len(got) == len(rows)
    kind = sorted(((r.key, r.record_type, r.refers_to) for r in got), key=str)
    revisits = [k for k in kind if k[1] == "revisit"]
    assert revisits == sorted([(5, "revisit", 9), (2, "revisit", 9), (9, "revisit", 9), (None, "revisit", 11)], key=str)
    text = {r[0]: r[2] or "" for r in rows}
    for r in got:
        assert r.payload_digest == hashlib.sha1(text[r.key].encode()).hexdigest() and r.payload_bytes == len(text[r.key].encode())
        assert r.payload is None or bytes(r.payload) == text[r.key].encode()


def test_empty(spark, tmp_path):
    table = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_warc(table, f"file://{tmp_path}/e").count() == 0 and warc.read_warc(spark, f"file://{tmp_path}/e").count() == 0


def test_a_changed_byte_is_an_error(spark, tmp_path):
    table = spark.createDataFrame([(1, "u", "abc" * 50)], "page_id long, url string, html string")
    name = warc.write_warc(table, f"file://{tmp_path}/c").first()["name"]
    raw = gzip.open(f"{tmp_path}/c/{name}").read().replace(b"abcabc", b"abcabd", 1)
    with gzip.open(f"{tmp_path}/c/{name}", "wb") as f:
        f.write(raw)
    with pytest.raises(Exception, match="differs"):
        warc.read_warc(spark, f"file://{tmp_path}/c").count()


def test_range_bounds_cover_skewed_keys(spark):
    import numpy as np

    keys = [(k, 10) for k in range(100)] + [(10**15, 10), (-(10**15), 10)] + [(55, 100)] * 7
    bounds, cuts = warc.range_bounds(spark.createDataFrame(keys, "k long, w long"), "k", "w", 100)
    assert (np.diff(bounds) > 0).all() and bounds[0] == -(10**15) and len(bounds) >= 9
    per = [sum(w for k, w in keys if lo <= k < hi) for lo, hi in zip(bounds.tolist(), [*bounds[1:].tolist(), 1 << 62])]
    assert all(w <= 100 * c for w, c in zip(per, cuts.tolist())) and dict(zip(bounds.tolist(), cuts.tolist()))[55] == 8


def test_a_hot_key_and_null_keys_are_spread_over_shards(spark, tmp_path):
    rows = [(None if k % 2 else 3, f"u{k}", f"{k} page " * 150) for k in range(80)] + [(9, "u", "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_warc(table, f"file://{tmp_path}/h", shard_bytes=4000).collect()
    assert len({m["shard"] for m in manifest}) > 10 and sum(m["records"] for m in manifest) == 81
    got = warc.read_warc(spark, f"file://{tmp_path}/h").collect()
    assert sorted((str(r.key), bytes(r.payload).decode()) for r in got) == sorted((str(k), t) for k, _, t in rows)


def members(raw):
    """Where the gzip members of a file end."""
    import zlib

    out, rest = [], raw
    while rest:
        d = zlib.decompressobj(31)
        d.decompress(rest)
        rest = d.unused_data
        out.append(len(raw) - len(rest))
    return out


@pytest.mark.parametrize("how", ["cut", "longer", "lost", "manifest"])
def test_a_file_that_is_not_what_the_manifest_says_is_an_error(spark, tmp_path, how):
    table = spark.createDataFrame([(k, f"u{k}", f"page {k}") for k in range(20)], "page_id long, url string, html string")
    out = f"file://{tmp_path}/t"
    name = warc.write_warc(table, out).first()["name"]
    path = tmp_path / "t" / name
    raw = path.read_bytes()
    if how == "cut":
        path.write_bytes(raw[: members(raw)[10]])
    elif how == "longer":
        path.write_bytes(raw + raw[members(raw)[0] : members(raw)[1]])
    elif how == "lost":
        path.unlink()
    else:
        (tmp_path / "t" / warc.MANIFEST / "_SUCCESS").unlink()
    with pytest.raises(Exception, match="whole manifest" if how == "manifest" else "No such file|differs from the manifest"):
        warc.read_warc(spark, out).count()
