"""Token counts, BPE and token shards against the tokenizer libraries."""

import random
import zlib

import numpy as np
import pytest

from seqmesh.llm import byte_bpe, latin_words, piece_codec, token_counts, token_shards

P = pytest.importorskip("public_tokenizers")
BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
LETTERS = "a b'sé\x00\x1c\x1d\x1f\x85\xa0  \t\n\r²½٣ßª中😀'll're 12_-.…​　́Ǆ▁<s></s>▁▁  the of"


def samples():
    r = random.Random(4)
    rows = ["", " ", "<|endoftext|>", "a<|endoftext|> b", "The quick brown fox's 3 tails\n\n  ran.", "x" * 3000, " " * 500 + "y", "zażółć gęślą jaźń"]
    return rows + ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 40))) for _ in range(400)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 5) for i, t in rows], "doc_id long, text string, ids string, n_tokens int")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


def test_segment_trees(library):
    v = byte_bpe.Vocabulary(open(BYTES, "rb").read())
    for t in samples():
        words = v.pretokens(t)
        assert "".join(words) == t
        ids = [i for w in byte_bpe.encode_many(words, v) for i in w]
        assert ids == library.encode(t, add_special_tokens=False).ids
        long = [i for w in words for i in ([v.specials[w]] if w in v.specials else byte_bpe.merge_long([v.first_list[b] for b in w.encode()], v))]
        assert long == ids


def test_encode_decode(spark, library):
    rows = [*enumerate(samples()), (3, None), (3, "twice"), (None, "no id")]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.encoded(frame(spark, rows), BYTES).collect())
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i is not None, i or 0, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    ids = byte_bpe.encode(frame(spark, rows), BYTES)
    assert sorted((r.doc_id or -1, r.text) for r in byte_bpe.decode(ids, BYTES).collect()) == sorted((i if i else -1, t or "") for i, t in rows)


def test_a_full_memo_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "CACHE", 10)
    v = byte_bpe.Vocabulary(open(BYTES, "rb").read())
    known = byte_bpe.Memo(lambda words: byte_bpe.encode_many(words, v))
    for t in samples()[:50]:
        words = v.pretokens(t)
        known.ready([words])
        assert [i for w in words for i in known[w]] == library.encode(t, add_special_tokens=False).ids


def test_piece_counts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = token_counts.PieceModel(open(PIECES, "rb").read())
    for t in samples():
        assert sum(model.counts(token_counts.pretokens(t))) == len(sp.encode(t)), t
    long = "".join(random.Random(2).choice("abcdefg") for _ in range(5000))
    assert model.counts(["▁" + long]) == [len(sp.encode(long))]
    huge = "".join(random.Random(4).choice("etaoinshrdlucm") for _ in range(100_000))
    assert model.counts(["▁" + huge, "▁a", ""]) == [len(sp.encode(huge)), len(sp.encode("a")), 0]
    rows = [*enumerate(samples()), (1, None), (None, "x")]
    got = token_counts.token_counts(frame(spark, rows), PIECES, 20).collect()
    want = sorted((i or 0, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 20) for i, t in rows)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


@pytest.mark.parametrize("seed", range(6))
def test_rounds_against_merging_one_by_one(seed):
    """Pieces with scores drawn by chance, ties among them, so that merges make pairs of lower rank all the time."""
    r = random.Random(seed)
    pieces = {c: 0.0 for c in "abc"} | {"".join(r.choice("abc") for _ in range(r.randint(2, 5))): float(r.randrange(12)) for _ in range(60)}
    model = token_counts.PieceModel.__new__(token_counts.PieceModel)
    model._tables(pieces)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(1, 40))) for _ in range(300)]
    for w, n in zip(words, model.counts(words), strict=True):
        s = list(w)
        while found := [(-pieces[a + b], i) for i, (a, b) in enumerate(zip(s, s[1:])) if a + b in pieces]:
            i = min(found)[1]
            s[i : i + 2] = [s[i] + s[i + 1]]
        assert n == len(s), w


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.PieceCodec(open(PIECES, "rb").read())


def test_piece_rounds(pieces):
    sp, model = pieces
    for t in [*samples(), "▁", " ▁ ▁▁x", "\x00", "中文字 слово العربية", "e" * 2000]:
        ids = sp.encode(t, add_eos=True)
        assert model.encode(t) == ids and model.decode(ids) == sp.decode(ids), t
    huge = "".join(random.Random(4).choice("etaoinshrdlucm") for _ in range(100_000))
    assert model.encode(huge) == sp.encode(huge, add_eos=True)


def test_pieces_of_any_ids_decode_like_the_library(pieces):
    sp, model = pieces
    r = random.Random(1)
    for _ in range(5000):
        ids = [r.choice([r.randrange(32_000), r.randrange(260), 0, 1, 2, 29_871]) for _ in range(r.randint(0, 6))]
        assert model.decode(ids) == sp.decode(ids), ids
    with pytest.raises(ValueError, match="outside the model"):
        model.decode([32_000])


def test_piece_encode_decode(spark, pieces):
    import hashlib

    sp, _ = pieces
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [*enumerate(samples()), (3, None), (3, "twice"), (None, "no id")]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_codec.encoded(frame(spark, rows), PIECES).collect())
    want = []
    for i, t in rows:
        ids = sp.encode(t or "", add_eos=True)
        want.append((i is not None, i or 0, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    assert got == sorted(want)
    ids = piece_codec.encode(frame(spark, rows), PIECES)
    back = piece_codec.decode(ids.unionByName(spark.createDataFrame([(-9, None)], "doc_id long, ids array<int>")), PIECES)
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == sorted([(-9, ""), *((i or -1, sp.decode(sp.encode(t or ""))) for i, t in rows)])


def test_empty_tables(spark, tmp_path):
    none = frame(spark, [])
    assert piece_codec.encoded(none, PIECES).count() == 0 and piece_codec.encode(none, PIECES).count() == 0
    assert byte_bpe.encoded(none, BYTES).count() == 0 and token_counts.token_counts(none, PIECES).count() == 0
    token_shards.write_shards(none, str(tmp_path / "e"), BYTES)
    assert token_shards.read_shards(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize(("size", "parts"), [(1 << 20, 4), (300, 4), (300, 40), (5000, 13)])
def test_shards(spark, tmp_path, monkeypatch, library, size, parts):
    monkeypatch.setattr(token_shards, "SHARD_IDS", size)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))  # more parts than tasks that read them
    try:
        _check_shards(spark, tmp_path, library)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _check_shards(spark, tmp_path, library):
    rows = [*((7 * i, t) for i, t in enumerate(samples())), (14, None), (None, "first"), (-3, "negative")]
    path = str(tmp_path / "s")
    token_shards.write_shards(frame(spark, rows).repartition(5), path, BYTES, end=0)
    got = token_shards.read_shards(spark, path).collect()
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((start, i, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want


def test_grammar_random_access():
    r = np.random.default_rng(3)
    ids = r.zipf(1.3, 40_000).clip(1, 900).astype(np.uint32)
    ids[5000:9000] = np.tile(ids[:40], 100)
    ids[20_000:21_000] = 5
    lengths = [10_000, 0, 25_000, 5_000]
    s = token_shards.Shard(token_shards.image([None, 3, 4, 5], lengths, ids, 1000))
    assert len(s.seq) < 0.7 * len(ids) and len(s.counts) and s.nulls == 1
    assert (s.read(0, s.n_ids) == ids).all()
    for at in (0, 1, 999, 5017, 20_500, 39_990):
        assert (s.read(at, 37) == ids[at : at + 37]).all()
    edge = np.r_[0, np.cumsum(lengths)]
    for k in range(4):
        assert (s.document(k) == ids[edge[k] : edge[k + 1]]).all()
    assert sorted(s._size(s.bodies[b : b + n]).sum() for b, n in zip(s.begin, s.counts)) == sorted(s.sizes.tolist())
    with pytest.raises(ValueError, match="not a token shard"):
        token_shards.Shard(b"nope")


@pytest.mark.parametrize("n", [0, 1, 2, 30, 300, 1000, 20_000, 50_000])
def test_images_of_any_size_with_the_real_vocabulary(n):
    r = np.random.default_rng(n)
    for high in (3, 400, 20_000, 50_257):
        ids = r.zipf(1.2, n).clip(1, high).astype(np.uint32) - 1
        s = token_shards.Shard(token_shards.image([1], [n], ids, 50_257))
        assert (s.read(0, n) == ids).all()
    with pytest.raises(ValueError, match="first nonterminal"):
        token_shards.repair(np.array([50_257, 1], dtype=np.uint32), 50_257)


def test_equal_short_texts(spark, tmp_path, library):
    rows = [(i % 7, "the same short text") for i in range(40)]
    token_shards.write_shards(frame(spark, rows), str(tmp_path / "q"), BYTES)
    n = len(library.encode("the same short text").ids) + 1
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_shards.read_shards(spark, str(tmp_path / "q")).collect())
    assert got == [(n * k, i, n) for k, i in enumerate(sorted(i for i, _ in rows))]


def overlapfree(seq):
    """How often each pair stands in a sequence, counted from the left without overlap."""
    count, last = {}, {}
    for i, p in enumerate(zip(seq, seq[1:])):
        if last.get(p) != i - 1 or p[0] != p[1]:
            count[p], last[p] = count.get(p, 0) + 1, i
    return count


def plain_repair(seq, first):
    """Re-Pair by recounting everything for each rule: (how often each rule's pair occurred, rules, sequence)."""
    seq, often, rules = list(seq), [], []
    while True:
        count = overlapfree(seq)
        best = max(count, key=count.get, default=None)
        if best is None or count[best] < 2:
            return often, rules, seq
        out, i = [], 0
        while i < len(seq):
            if tuple(seq[i : i + 2]) == best:
                out.append(first + len(rules))
                i += 2
            else:
                out.append(seq[i])
                i += 1
        often.append(count[best])
        rules.append(best)
        seq = out


@pytest.mark.parametrize("kind", ["words", "runs", "copies", "few", "empty", "one"])
def test_repair_against_a_plain_one(kind):
    r = np.random.default_rng(len(kind))
    ids = {
        "words": r.zipf(1.4, 2000).clip(1, 60),
        "runs": np.repeat(r.integers(0, 4, 300), r.integers(1, 9, 300)),
        "copies": np.tile(r.integers(0, 500, 150), 12),
        "few": r.integers(0, 3, 800),
        "empty": np.zeros(0),
        "one": np.zeros(1),
    }[kind].astype(np.uint32)
    often, rules, seq = plain_repair(ids.tolist(), 1000)
    steps, got = token_shards.repair(ids, 1000)
    made = [tuple(p) for step in steps for p in step.tolist()]
    # to the end: nothing is left to replace
    assert max(overlapfree(got.tolist()).values(), default=0) < 2
    # the fullest pair first: the first rule is one of the most frequent, and the grammar is as small as the plain one
    if rules:
        assert overlapfree(ids.tolist())[made[0]] == often[0]
    assert len(got) + 2 * len(made) <= 1.03 * (len(seq) + 2 * len(rules)) + 8
    flat, counts, sizes, name = token_shards.grammar(ids, 1000)
    uses = np.bincount(np.concatenate([flat, name]), minlength=1000)[1000:]
    assert len(uses) == len(counts) and (uses >= 2).all() and (counts >= 2).all()
    s = token_shards.Shard(token_shards.image([1], [len(ids)], ids, 1000))
    assert (s.read(0, len(ids)) == ids).all()


def test_repair_halves_long_repeats():
    ids = np.tile(np.arange(4096, dtype=np.uint32), 2)
    steps, seq = token_shards.repair(ids, 4096)
    assert len(seq) == 2 and len(steps) < 100


def test_repair_of_several_sequences_takes_steps_together():
    """Each keeps its own rules and ends as it would alone."""
    r = np.random.default_rng(8)
    many = [r.zipf(1.3, n).clip(1, 900).astype(np.uint32) for n in (6000, 0, 1, 2, 5000, 6000)]
    many += [np.tile(many[0][:50], 40), np.full(777, 3, dtype=np.uint32)]
    found = token_shards.repair_together(many, 1000)
    for ids, (rules, size, steps, seq) in zip(many, found, strict=True):
        alone, rest = token_shards.repair(ids, 1000)
        assert sum(steps) == len(rules) == len(size) and max(overlapfree(seq.tolist()).values(), default=0) < 2
        assert len(seq) + 2 * len(rules) <= 1.03 * (len(rest) + 2 * sum(map(len, alone))) + 8
        s = token_shards.Shard(token_shards.image([1], [len(ids)], ids, 1000, (rules, size, steps, seq)))
        assert (s.read(0, len(ids)) == ids).all() and (s._down(s.seq, s._size(s.seq)) == ids).all()


def test_latin_texts_are_cut_like_the_pattern():
    """White space, contractions and text edges in all orders, many texts at once."""
    v, r = byte_bpe.Vocabulary(open(BYTES, "rb").read()), random.Random(5)
    for _ in range(2000):
        rows = ["".join(r.choice("aab's''''tmdrevl lls  \n\t\x85\xa0 1²9.,-!Z\xe9ß\x1c") for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 5))]
        got = latin_words.cuts(np.frombuffer("".join(rows).encode("latin-1"), dtype=np.uint8), np.cumsum([0, *map(len, rows)]))
        assert got.tolist() == np.cumsum([0, *(len(w) for t in rows for w in v.pretokens(t))])[:-1].tolist(), rows


@pytest.mark.parametrize("known", [5, 800_000])
def test_ids_of_texts_together(monkeypatch, library, known):
    """Latin-1 texts, wider ones, special strings and long words side by side; keys that are alike; a memo that is full."""
    monkeypatch.setattr(token_shards, "KNOWN", known)
    monkeypatch.setattr(latin_words, "BLOCK", 1000)
    model, r = token_shards.Known(open(BYTES, "rb").read()), random.Random(6)
    rows = [*samples(), "\0", "\0\0", "a\0", "a" * 15, "a" * 16, "a" * 7 + " " + "a" * 8, "a" * 9, " " * 15, " " * 40 + "z", "é" * 15, "é" * 16]
    rows += [" ".join("".join(r.choice("abcd") for _ in range(r.randint(1, 18))) for _ in range(400)) for _ in range(20)]
    for part in (rows, rows[::-1], rows[:1], [], ["", ""]):
        assert model.encode(part) == [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in part]
    assert known > 5 or model.words.entries < 20_000
