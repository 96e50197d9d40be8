import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voxelframe.llm import packing, piece_bpe

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
LIBRARY, TOKENIZER = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(BYTES)
PARTS = st.lists(st.sampled_from(["a", "b", " ", "  ", "▁", "\n", "\n\n", "the", "er", "ion", "é", "ß", "中", "😀", "\t", "\r", "\x00", "\xa0", "\x1c", ".", ",", "!!", "###", "<|endoftext|>", "<s>", "12", "'s", "x'll", "Ω", "́"]), max_size=14).map("".join) | st.text(max_size=20)


def ids(packed: bytes) -> list[int]:
    return np.frombuffer(packed, dtype="<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(PARTS)
def test_pieces_equal_the_library(text):
    model = piece_bpe.load(PIECES)
    want = LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert ids(model.encode(text)) == want and model.decode(want) == LIBRARY.decode(want).encode()


@settings(max_examples=400, deadline=None)
@given(PARTS)
def test_words_equal_the_tokenizer(text):
    assert ids(packing.load(BYTES).encode(text)) == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_encode_documents(odd, none):
    rows = piece_bpe.encode_documents(odd, PIECES, with_ids=True).collect()
    assert len(rows) == 10 and piece_bpe.encode_documents(none, PIECES).count() == 0
    texts = Counter((r["doc_id"], r["text"] or "") for r in odd.collect())
    got = Counter()
    for r in rows:
        text = next(t for (i, t) in texts if i == r["doc_id"])
        want = LIBRARY.encode(text, add_bos=True, add_eos=True)
        assert r["ids"] == want and r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(want).encode()).hexdigest()
        got[r["doc_id"], text] += 1
    assert got == texts


def check_packing(rows, texts, capacity=1024):
    """Pieces cover the documents, sequences have neither gaps nor overlaps."""
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for key, many in texts.items():
        want = [TOKENIZER.encode(t, add_special_tokens=False).ids + [2] for t in many]
        assert len({tuple(w) for w in want}) == 1
        at = 0
        for piece in range(max(r["piece"] for r in by[key]) + 1):
            same = [r for r in by[key] if r["piece"] == piece]
            assert len(same) == len(many)
            for r in same:
                assert r["start"] == at and (piece == 0 or r["length"] == capacity)
                assert r["ids_crc32"] == zlib.crc32(np.array(want[0][at : at + r["length"]], dtype="<u4").tobytes())
            at += same[0]["length"]
        assert at == len(want[0])
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_pack(odd, none):
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    check_packing(packing.pack(odd, BYTES).collect(), texts)
    assert packing.pack(none, BYTES).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=12))
def test_kinds_of_bins(counts):
    first = packing.best_fit(counts, 40)
    last = packing.local_search(first, 40)
    for kinds in (first, last):
        held = Counter()
        for kind, n in kinds.items():
            assert sum(kind) <= 40 and n > 0
            for size in kind:
                held[size] += n
        assert held == Counter(counts)
    squares = [sum(n * sum(k) ** 2 for k, n in kinds.items()) for kinds in (first, last)]
    assert squares[1] >= squares[0] and sum(last.values()) <= sum(first.values())


def test_local_search_saves_bins():
    counts = dict(Counter(np.random.default_rng(0).integers(200, 300, 3000).tolist()))
    first, last = packing.best_fit(counts, 1024), packing.local_search(packing.best_fit(counts, 1024), 1024)
    least = -(-sum(k * n for k, n in counts.items()) // 1024)
    assert least <= sum(last.values()) < sum(first.values())


def improvable(kinds, capacity):
    """Whether moving a piece, or swapping one or two for one, between two bins raises the sum of squared fills."""
    under = [k for k in kinds if sum(k) < capacity]
    for a in under:
        for b in under:
            if a == b and kinds[a] < 2:
                continue
            gives = {(x,) for x in b} | {(x, y) for i, x in enumerate(b) for y in b[i + 1 :]}
            for give in gives:
                for take in {0, *a} if len(give) == 1 else set(a):
                    g = sum(give) - take
                    if sum(a) + g <= capacity and sum(b) - g <= capacity and (sum(a) + g) ** 2 + (sum(b) - g) ** 2 > sum(a) ** 2 + sum(b) ** 2:
                        return True
    return False


def test_local_search_ends_at_an_optimum():
    rng = np.random.default_rng(1)
    for low, high, n in ((12, 20, 40), (9, 25, 60), (3, 39, 25)) * 10:
        kinds = {}
        for x in rng.integers(low, high, n).tolist():  # a poor start: two pieces at most in a bin
            kinds[(x,)] = kinds.get((x,), 0) + 1
        assert not improvable(packing.local_search(kinds, 40), 40)


def test_no_move_is_left_on_documents(spark):
    """The lengths of the given documents: every pair of underfull bins is tried for every exchange."""
    pieces = packing.cut_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), BYTES)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").count().withColumnRenamed("count", "n").collect()}
    start = packing.best_fit(counts, 1024)
    assert not improvable(packing.local_search(start, 1024), 1024)
    rng = np.random.default_rng(3)
    many = dict(Counter(rng.choice(list(counts), 1500).tolist()))  # more bins that are not full
    few = packing.local_search({(k,): n for k, n in list(many.items())[:25]}, 1024)
    assert not improvable(few, 1024) and sum(n * sum(k) for k, n in few.items()) == sum(k * n for k, n in list(many.items())[:25])


def test_hot_lengths_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 7)
    texts = {i: ["a " * (i % 3 + 1)] for i in range(200)} | {500: ["a " * 2500] * 3, None: ["b"] * 30}
    df = spark.createDataFrame([(i, t) for i, many in texts.items() for t in many], "doc_id long, text string")
    check_packing(packing.pack(df, BYTES).collect(), texts)


def test_two_for_one_and_move():
    assert packing._best_move((6,), (3, 1), 4) == ((3, 1), (), 4) or packing._best_move((6,), (3, 1), 4)[2] == 3
    assert packing.local_search({(6,): 1, (4,): 1}, 10) == {(6, 4): 1}


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 2048])
def test_only_the_first_piece_is_short(spark, n):
    df = spark.createDataFrame([(1, "a " * (n - 1))], "doc_id long, text string")
    rows = sorted(packing.cut_documents(df, BYTES).collect(), key=lambda r: r.piece)
    total = len(TOKENIZER.encode("a " * (n - 1), add_special_tokens=False).ids) + 1
    assert sum(r.length for r in rows) == total and all(r.length == 1024 for r in rows[1:])


def test_a_known_word_and_a_mark_is_looked_up_at_once(monkeypatch):
    encoder = packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.encode("so some words were seen")
    monkeypatch.setattr(encoder, "_alone", lambda text: {"so": encoder.tokenizer.encode("so").ids}.get(text) and encoder._encode(text))
    text = "so some, words. were: seen;"
    assert encoder.encode(text) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    for text in ("so words., seen", "so . , words!? seen", "so some$ words) ,seen ."):
        assert packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.json")).encode(text) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_workers_give_the_encoder_back(spark):
    """What a worker remembers of words lives from task to task of the packing, and is gone in the tasks of other operators."""
    docs = spark.createDataFrame([(k, f"some words {k}") for k in range(40)], "doc_id long, text string")

    def held(batches):
        import gc
        import os

        from voxelframe.llm.packing import WordEncoder

        n = sum(isinstance(x, WordEncoder) for x in gc.get_objects())
        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "n": [n]})

    for _ in range(2):
        assert packing.cut_documents(docs.repartition(4), BYTES).count() == 40
        rows = docs.repartition(4).mapInArrow(held, "pid long, n long").collect()
        assert rows and all(r.n == 0 for r in rows)
