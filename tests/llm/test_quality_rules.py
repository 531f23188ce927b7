import base64
import random

import zstandard
from helpers import LONG, empty, table, ugly

from codeloom.llm import quality_rules as Q


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def prose(n, seed=3):
    r = random.Random(seed)
    base = "of the and in a to was it for with on that by from at his as which or were but not this have had they one their been has its more".split()
    return " ".join(r.choice(base) + r.choice(["", "", "ing", "ed", "er", "ly", str(r.randrange(9))]) for _ in range(n)) + "."


def test_ratio_is_that_of_the_whole_text(spark):
    text = prose(900)
    r = by_id(Q.compression_bands(table(spark, [(1, text)])))[1]
    raw = text.encode()
    squeeze = zstandard.ZstdCompressor(level=Q.LEVEL, write_content_size=False).compress
    assert r.ratio == len(squeeze(raw)) / len(raw) and r.keep
    parts = [raw[k : k + Q.CHUNK_BYTES] for k in range(0, len(raw), Q.CHUNK_BYTES)]
    each = [len(squeeze(p)) / len(p) for p in parts if len(p) >= Q.LEAST_CHUNK]
    assert (r.chunks, r.least_chunk, r.largest_chunk) == (len(each), min(each), max(each))


def test_repetitive_and_incompressible_texts_go(spark):
    noise = base64.b85encode(random.Random(1).randbytes(4000)).decode()
    rows = [(1, "spam and eggs. " * 400), (2, noise), (3, prose(600)), (4, prose(3000) + noise * 5)]
    r = by_id(Q.compression_bands(table(spark, rows)))
    assert (r[1].reason, r[2].reason, r[3].reason) == ("repetitive", "incompressible", None)
    assert not r[4].keep  # half of it is noise
    assert [x.doc_id for x in Q.kept(table(spark, rows)).collect()] == [3]


def test_bands_depend_on_length(spark):
    bands = ((0, None, None), (64, None, 0.1), (1000, None, None))
    r = by_id(Q.compression_bands(table(spark, [(1, prose(30)), (2, prose(500))]), bands=bands, chunk_limits=(0, 9)))
    assert r[1].reason == "incompressible" and r[2].keep and (r[1].band, r[2].band) == (1, 2)


def test_defined_results(spark):
    rows = Q.compression_bands(ugly(spark)).collect()
    assert len(rows) == 11
    for r in rows:
        if r.n_bytes < 64:
            assert r.keep and r.ratio is None
    assert next(r for r in rows if r.doc_id == 4).n_bytes == len(LONG.encode())
    assert len({(r.ratio, r.keep) for r in rows if r.doc_id in (5, 6)}) == 1
    assert Q.compression_bands(empty(spark)).count() == 0
