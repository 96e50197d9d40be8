import hashlib
import re
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voxelframe.llm import sharding, warc


def test_table_is_even_and_steady():
    names = [f"s{k}" for k in range(8)]
    full = sharding.fill_table(names, 6151)
    sizes = Counter(full)
    assert len(full) == 6151 and max(sizes.values()) - min(sizes.values()) <= 1
    less = sharding.fill_table(names[:-1], 6151)
    moved = sum(a != b for a, b in zip(full, less, strict=True) if a != 7)
    assert moved < 0.1 * 6151  # few slots change hands beyond those of the shard that left
    weighted = Counter(sharding.fill_table(names, 6151, [2] + [1] * 7))
    assert weighted[0] == pytest.approx(2 * weighted[1], rel=0.01)
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def test_permutation_turns():
    """Against the literal rule: in turns, each shard takes the first free slot of its permutation."""
    names, size = ["a", "b", "c"], 13
    order = []
    for s in names:
        number = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
        offset, skip = number(f"offset:{s}") % size, number(f"skip:{s}") % (size - 1) + 1
        order.append([(offset + j * skip) % size for j in range(size)])
    owner = {}
    while len(owner) < size:
        for k in range(3):
            if len(owner) < size:
                owner[next(x for x in order[k] if x not in owner)] = k
    assert sharding.fill_table(names, size) == [owner[i] for i in range(size)]


def test_rows(odd, none, tmp_path):
    names = [f"s{k}" for k in range(4)]
    out = sharding.shard_rows(odd, "doc_id", names, 101)
    owner = sharding.fill_table(names, 101)
    for r in out.collect():
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 101
        assert (r.shard_slot, r.shard_id, r.shard) == (slot, owner[slot], names[owner[slot]])
    assert out.count() == 10 and set(odd.columns) <= set(out.columns) and sharding.shard_rows(none, "doc_id", names, 101).count() == 0
    sharding.write_shards(odd.select("doc_id", "text"), "doc_id", f"{tmp_path}/s", names, size=101)
    assert odd.sparkSession.read.parquet(f"{tmp_path}/s").count() == 10


BODY = "<html>" + "x" * 1200 + "</html>"
PAGES = [(1, "http://a/", BODY), (2, "http://b/", BODY), (3, None, BODY), (3, None, BODY), (4, "http://c/", "short"), (5, "http://d/", "short"), (6, "u", None), (None, "n", BODY), (7, "line\r\nbreak", "WARC/1.1\r\n\r\n" * 300), (8, "é", "ü" * 600)]


def test_archive(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumnRenamed("url", "url").selectExpr("*", "'clash' as payload", "1 as refers_to", "'x' as record_type")
    rows = warc.archive(pages, f"file://{tmp_path}/w", with_payload=True).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)
    want = []
    for i, _, html in PAGES:
        b = (html or "").encode()
        revisit = html == BODY and i != 3
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert got == sorted(want, key=str)
    assert {bytes(r.payload) for r in rows if r.record_type == "response"} == {(h or "").encode() for i, _, h in PAGES if h != BODY or i == 3}
    assert warc.archive(pages.limit(0), f"{tmp_path}/none").count() == 0


def test_dictionary_comes_first(spark, tmp_path):
    pages = spark.range(400).selectExpr("id as page_id", "concat('http://h/', id) as url", "concat('<html><head><title>page ', id, '</title></head><body><p>', repeat(sha1(cast(id as string)), 5), '</p></body></html>') as html").coalesce(1)
    rows = warc.archive(pages, f"{tmp_path}/w").collect()
    assert len(rows) == 400 and all(r.record_type == "response" for r in rows)
    (path,) = (tmp_path / "w").glob("*.warc.zst")
    data = path.read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and data[8:12] == b"\x37\xa4\x30\xec" and size <= warc.DICTIONARY_BYTES  # a Zstandard dictionary
    import zstandard

    first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj().decompress(data[8 + size :])
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: response") and first.endswith(b"\r\n\r\n") and first.count(b"WARC/1.1\r\n") == 1
    for damaged, n in ((data[:-40], 400), (data, 401)):
        path.write_bytes(damaged)
        with pytest.raises(Exception, match="archive ends|were written"):
            warc.read_archives(spark.createDataFrame([(str(path), n)], "path string, records long")).collect()


def test_records_are_valid(spark, tmp_path):
    """What the standard asks for: unique ids, a date, a target, and the HTTP entity as payload; revisits name what they repeat."""
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.archive(pages, f"{tmp_path}/w").count()
    seen, types = set(), Counter()
    for path in (tmp_path / "w").glob("*.warc.zst"):
        with path.open("rb") as f:
            for h, _ in warc.read_archive(f):
                assert re.fullmatch("<urn:uuid:[0-9a-f-]{36}>", h["WARC-Record-ID"]) and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", h["WARC-Date"]) and h["WARC-Target-URI"]
                assert h["WARC-Type"] == "response" or (h["WARC-Profile"] == warc.PROFILE and h["WARC-Refers-To-Target-URI"] == warc.NO_URL and h["WARC-Refers-To-Date"] == h["WARC-Date"])
                seen.add(h["WARC-Record-ID"])
                types[h["WARC-Type"]] += 1
    assert len(seen) == len(PAGES) and types["revisit"] == 3
    with pytest.raises(TypeError, match="integers"):
        warc.archive(pages.selectExpr("cast(page_id as string) as page_id", "url", "html"))


def test_lost_attempts_leave_nothing(spark, tmp_path):
    """A task that fails after it wrote leaves a part, and a whole archive that no manifest lists; both go."""
    folder = tmp_path / "w"
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    chosen = warc.choose_responses(pages, warc.repeated_payloads(pages))
    with pytest.raises(Exception, match="boom"):
        warc.write_archives(chosen.withColumn("html", F.when(F.col("page_id") == 8, F.raise_error(F.lit("boom"))).otherwise(F.col("html"))), str(folder), b"", "run").collect()
    (folder / "run-000000-999.warc.zst").write_bytes(b"an attempt whose answer was lost")
    (folder / "other.warc.zst").write_bytes(b"not of this run")
    manifest = warc.write_archives(chosen, str(folder), b"", "run")
    manifest = spark.createDataFrame(manifest.collect(), manifest.schema)
    warc.sweep(str(folder), "run", manifest)
    assert sorted(x.name for x in folder.iterdir()) == sorted([r.path.rsplit("/", 1)[1] for r in manifest.collect()] + ["other.warc.zst"])
    assert warc.read_archives(manifest).count() == len(PAGES)


def test_very_long_page(spark, tmp_path):
    rows = warc.archive(spark.createDataFrame([(1, "u", "<p>" + "long " * 2_000_000), (2, "u", "x")], "page_id long, url string, html string"), f"{tmp_path}/w").collect()
    assert sorted((r.page_id, r.payload_bytes) for r in rows) == [(1, 10_000_003), (2, 1)]


def test_dictionary_is_trained_on_records(spark):
    """Whole records as written: with headers, long pages to their end, revisits without a body; one page_id does not crowd out others."""
    long = "<html>" + "y" * 40_000 + "the end</html>"
    rows = [(1, "http://a/", long), *((k, f"http://b/{k}", BODY) for k in range(2, 6)), *((7, f"http://c/{k}", f"page {k}") for k in range(50))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    repeated = warc.repeated_payloads(pages)
    got = warc.sample_records(pages, repeated)
    bare = lambda x: re.sub(rb"urn:uuid:[0-9a-f-]*", b"", x)
    assert sorted(map(bare, got)) == sorted(bare(warc.record(r.page_id, r.url, r.html.encode(), r.payload_digest, r.refers_to, r.refers_to_url)) for r in warc.choose_responses(pages, repeated).collect())
    assert sum(b"WARC-Type: revisit" in x and b"Content-Length: 0\r\n\r\n\r\n\r\n" in x for x in got) == 3 and any(x.endswith(b"the end</html>\r\n\r\n") for x in got)
    many = spark.range(20_000).selectExpr("1 as page_id", "concat('http://h/', id) as url", "repeat('z', 100) as html")
    assert 500 < len(warc.sample_records(many, warc.repeated_payloads(many))) < 1500
