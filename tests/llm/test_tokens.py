"""Packing and alignment against the tokenizers applied to whole texts."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import alignment, packing, segments, tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string"


def byte_level(plain):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = plain
    return model


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(11)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "\r\n", " ", "　 ", " ", "​", "é", "é", "ß", "漢字", "🙂", "<s>", "<|endoftext|>", "<0x41>", "it's", "I'LL", "12", "...", "\x00", "\x7f ", "— ", "“x” ", "\u0085", "\x1c ", ").\r"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    texts += [None, "", " ", "\n", "   ", "lost▁here and there", "▁", "<|endoftext|>", "x" * 5_000, "word " * 3_000, "a b c. " * 900, "same text", "same text"]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    return rows + rows[5:9]


# 12: packing


def check_packing(rows, packed, capacity=1024):
    model = byte_level(plain=False)
    places, lengths = defaultdict(list), Counter()
    for r in packed:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for sequence in places.values():
        at = 0
        for offset, length in sorted(sequence):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter()
    for doc_id, text in rows:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        stops = range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)
        for piece, (start, stop) in enumerate(zip([0, *stops], stops, strict=False)):
            want[doc_id, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())] += 1
            lengths[stop - start] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    return len(places), -(-sum(n * k for n, k in lengths.items()) // capacity), lengths


def test_packing_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    used, least, lengths = check_packing([(r["doc_id"], r["text"]) for r in docs.collect()], packing.packing_digest(spark, docs).collect())
    assert least <= used <= least * 1.01 + 1


def test_packing_of_odd_rows(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(packing, "PART_BYTES", 700)
    monkeypatch.setattr(packing, "SLICE_BYTES", 5_000)
    monkeypatch.setattr(packing, "CELL_BITS", 3)
    docs = spark.createDataFrame(odd_rows, SCHEMA).withColumns({c: F.lit(1) for c in ("length", "row", "cell", "n", "place")})
    check_packing(odd_rows, packing.packing_digest(spark, docs).collect())
    assert packing.packing_digest(spark, docs.limit(0)).count() == 0


def test_sequences_hold_the_ids(spark, odd_rows):
    docs = spark.createDataFrame(odd_rows, SCHEMA)
    packed = packing.pack(spark, docs, keep_ids=True).cache()
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert sum(map(len, whole.values())) == packed.agg(F.sum("length")).first()[0]


@pytest.mark.parametrize("histogram", [{}, {1024: 7}, {1: 5}, {600: 5_000}, {513: 3, 511: 3}, {n: 40 for n in range(1, 1025)}, {341: 3_000, 342: 1_500, 1000: 50, 24: 50, 3: 1}])
def test_plans_hold_every_piece_once(histogram):
    plan = packing.plan_packing(histogram)
    held = Counter()
    for filling, times in plan.uses:
        assert sum(filling) <= 1024 and times > 0
        for n in filling:
            held[n] += times
    assert held == Counter(histogram)
    least = max(-(-sum(n * k for n, k in histogram.items()) // 1024), sum(k for n, k in histogram.items() if n > 512))
    assert plan.n_sequences <= least * 1.01 + 1


def test_the_program_covers_near_its_least_total():
    rng = np.random.default_rng(2)
    lengths = np.unique(rng.integers(1, 200, 60))
    demand = rng.integers(300, 900, len(lengths)).astype(float)
    used = packing.configuration_lp(lengths, demand, 200, 0.1)
    covered = np.zeros(len(lengths))
    for filling, x in used.items():
        assert sum(lengths[i] * n for i, n in filling) <= 200
        for i, n in filling:
            covered[i] += n * x
    assert (covered >= demand * 0.999).all()
    assert sum(used.values()) <= 1.1 * (lengths * demand).sum() / 200 + 1


def test_knapsack_against_all_fillings():
    rng = np.random.default_rng(4)
    for _ in range(20):
        lengths, prices = np.unique(rng.integers(1, 15, 5)), rng.random(5)
        prices = prices[: len(lengths)]
        best, _ = packing.knapsack(lengths, prices, 30)
        plain = [0.0] * 31
        for c in range(1, 31):
            plain[c] = max([plain[c - 1]] + [prices[i] + plain[c - n] for i, n in enumerate(lengths) if n <= c])
        assert np.allclose(best, plain)


# 13: alignment


def aligned_by_hand(rows):
    """The digest of every row, from both tokenizers on whole texts."""
    left, right = byte_level(plain=True), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = tokens.byte_letters()
    spelled_a = {i: bytes(letters.get(c, 0) for c in w) for w, i in left.get_vocab().items()}
    spelled_b = lambda i: bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], Counter()
    for doc_id, text in rows:
        if not text:
            found.append((doc_id, None))
            continue
        whole = (" " + text).encode()
        a, b = left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)
        if b"".join(map(spelled_a.get, a)) != whole or b"".join(map(spelled_b, b)) != whole:
            found.append((doc_id, None))
            continue
        ends_a, ends_b = (np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((spelled_a.get, a), (spelled_b, b)))
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            links.append((a[p - 1], b[q - 1]))
            i, j = p, q
        counts.update(links)
        found.append((doc_id, (len(a), len(b), groups, links)))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for doc_id, f in found:
        if f is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = f
            out.append((doc_id, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return Counter(out)


def aligned_rows(df):
    return Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect())


def test_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert aligned_rows(alignment.alignment_digest(spark, docs)) == aligned_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("broadcast", [0, 4_000_000])
def test_alignment_of_odd_rows(spark, odd_rows, monkeypatch, broadcast):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 2_000)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 300)
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", broadcast)
    docs = spark.createDataFrame(odd_rows, SCHEMA).withColumns({c: F.lit(1) for c in ("slice", "code", "segment", "n", "codes", "part")})
    got = alignment.alignment_digest(spark, docs)
    assert aligned_rows(got) == aligned_by_hand(odd_rows)
    assert alignment.alignment_digest(spark, docs.limit(0)).count() == 0


def test_groups_are_kept_on_demand(spark):
    docs = spark.createDataFrame([(1, "Hello there, world")], SCHEMA)
    row = alignment.align_tokenizers(spark, docs, keep_groups=True).first()
    assert hashlib.sha256(row["groups"].encode()).hexdigest() == row["groups_sha256"] and row["groups"].count(";") == row["n_groups"] - 1


def test_segments_are_encoded_as_in_their_texts(odd_rows):
    left, right = tokens.ByteLevel(tokens.vocabulary("byte_bpe_50k.json"), plain=True), tokens.Pieces(tokens.vocabulary("piece_bpe_32k.model"))
    joined = segments.joined_pairs(left.entries) | segments.joined_pairs(right.entries)
    for _, text in odd_rows:
        raw = np.frombuffer((" " + (text or "")).encode(), np.uint8)
        parts = segments.string_array(raw, segments.segment_starts(raw, np.array([0, len(raw)]), joined)).to_pylist()
        assert "".join(parts) == " " + (text or "")
        for model in (left, right):
            assert sum(model.encode(parts), []) == model.encode([" " + (text or "")])[0]
