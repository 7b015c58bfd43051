"""The training-text operators against brute force, round trips, DuckDB and odd inputs."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sentrel.llm import chat, decontamination, exact_dedup, lm_score, near_dedup, pii, quality, queries, sentencepiece_codec, sharding, token_files
from sentrel.llm.batches import WORD_SPACES, WordHasher, WordTable, shared_folder
from sentrel.llm.pieces import Vocabulary
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LONG = "lorem ipsum dolor " * 20_000
#: Nulls, empty and odd texts, repeated rows, a repeated id, a null id, and columns with names that operators use.
ODD = [
    (1, None, "x", 1), (2, "", "y", 2), (3, LONG, None, 3), (4, "same words here for all of us", "z", 4), (4, "same words here for all of us", "z", 4),
    (5, "same words here for all of us", "z", 5), (6, "!!!", "z", 6), (7, "???", "z", 7), (None, "no id at all here", "z", 8), (4, "other text, same id", "z", 9),
    (8, "a▁b \x00 中文 🎉 x" + "y" * 300, "z", 10),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, score string, salt int").withColumn("slot", F.lit(1))


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("doc_id = -1")


@pytest.fixture(scope="module")
def texts():
    return [r[0] for r in connect(SF).execute("select coalesce(text, '') from documents order by doc_id").fetchall()]


@pytest.mark.parametrize("key", sorted(queries.SQL))
def test_equals_duckdb(spark, key):
    ok, note = compare(spark, connect(SF), key, queries.QUERIES[key], queries.SQL[key], SF)
    assert ok, note


def test_codes_give_any_token():
    ids = np.random.default_rng(1).choice([0, 1, 255, 256, 65_535, 65_536, 2**31], 5000).astype(np.uint32)
    codes = token_files.Codes(token_files.pack(ids))
    at = np.random.default_rng(2).integers(0, 5000, 700)
    assert (codes.get(at) == ids[at]).all() and (codes.all() == ids).all() and len(codes) == 5000
    assert len(token_files.Codes(token_files.pack(ids[:0]))) == 0 == len(token_files.Codes(token_files.pack(ids[:0])).all())


def test_token_files(spark, odd, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    path = shared_folder(spark, "tokens")
    token_files.write_tokens(documents, path, WORDS)
    have = {r["doc_id"]: r for r in token_files.read_documents(spark, path, with_ids=True).collect()}
    start = 0
    for row in documents.orderBy("doc_id").collect():
        ids = tokenizer.encode(row["text"] or "", add_special_tokens=False).ids + [1]
        own = have[row["doc_id"]]
        assert (own["start"], own["n_tokens"], own["ids"]) == (start, len(ids), ids)
        assert own["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    first = have[0]["ids"]
    wanted = spark.createDataFrame([(0,), (5,), (5,), (start,), (-1,)], "position long")
    got = {r["position"]: r["id"] for r in token_files.read_tokens(spark, path, wanted).collect()}
    assert got == {0: first[0], 5: first[5]}
    for rows, n in ((odd, len(ODD)), (none, 0)):
        path = shared_folder(spark, "tokens")
        token_files.write_tokens(rows, path, WORDS)
        assert token_files.read_documents(spark, path).count() == n


def test_word_encoding_equals_the_library():
    from tokenizers import Tokenizer

    encode = token_files.word_encoder(Path(WORDS).read_text())
    text = "a\x0bb\x0c c\x1cd\x85e don't 'S É é ́x ΣΑΣ <|endoftext|>y <|ENDOFTEXT|> a&&&. 12.5 İx' é. é́. \"q\" x's, 's. ñ$$$ ###"
    flat, _ = encode([w for w in text.encode().split()])
    assert flat.tolist() == Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids


def best_cut(vocabulary, word):
    """The best segmentation of a short word by plain recursion over ends."""
    table = {vocabulary.pieces[i]: i for i in vocabulary.ids[vocabulary.ids >= 0]}
    best = [(0.0, [])] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - vocabulary.longest), end):
            piece = word[start:end]
            score = vocabulary.scores[table[piece]] if piece in table else vocabulary.lowest - 10 if end - start == 1 else None
            if score is not None and best[start] is not None and (best[end] is None or best[start][0] + score > best[end][0]):
                best[end] = (best[start][0] + score, best[start][1] + ([table[piece]] if piece in table else vocabulary.spell_bytes(piece)))
    return best[-1][1]


def test_pieces_equal_brute_force_and_library(texts):
    import sentencepiece

    vocabulary = Vocabulary(Path(MODEL).read_bytes())
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    words = sorted({" " + w for t in texts[:40] for w in t.split()})[:1500] + ["  two", " 🎉é中", " " + "x" * 80]
    flat, counts = sentencepiece_codec.segment(vocabulary, words)
    for word, ids in zip(words, np.split(flat, np.cumsum(counts)[:-1])):
        assert ids.tolist() == best_cut(vocabulary, word.replace(" ", "▁")), word
    flat, counts = sentencepiece_codec.segment(vocabulary, words, merges=True)
    for word, ids in zip(words, np.split(flat, np.cumsum(counts)[:-1])):
        assert ids.tolist() == library.encode(word[1:]), word


def test_word_table_forgets_and_never_keeps_long_words():
    calls = []

    def encode(words):
        calls.append(list(words))
        return np.concatenate([np.full(len(w), len(w), np.int32) for w in words]), np.array([len(w) for w in words])

    table = WordTable(encode, limit=1000, longest=8)
    words = [b"a", b"bb", b"x" * 9, b"a", b"y" * 20, b"x" * 9]
    for _ in range(3):
        ids, counts = table.ids(words)
        assert counts.tolist() == [len(w) for w in words] and ids.tolist() == [len(w) for w in words for _ in w]
    assert set(table.index) == {b"a", b"bb"} and calls[0] == [b"a", b"bb"] and [b"x" * 9, b"y" * 20] in calls[1:]
    for i in range(40):
        assert table.ids([b"w%d" % i])[1].tolist() == [len(b"w%d" % i)]
    assert len(table.index) < 20


def test_units_of_words_have_the_ids_of_the_whole_text():
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(WORDS), token_files.word_encoder(Path(WORDS).read_text())
    for text in (
        "Hello, World!! it's a.b, <|endoftext|>. Foo<|ENDOFTEXT|>!", 'ÉTÉ. Größe."x', "don't. 'S 's. I'LL,", "a×b. ×. 12.5%, (abc).",
        "…, ‘quoted’. 中文。字. 🎉! a🎉.", "\x00a.\x1cb, \x85 c", "", "A.B.C. ...a.. .5.", "x" * 300 + ". " + "y" * 200 + ",!",
    ):
        ids, _ = encode(token_files.units(text.encode()))
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_give_the_text_back(spark, odd, none):
    assert queries.QUERIES["op2_sentencepiece"](spark, SF).filter("not exact").isEmpty()
    rows = sentencepiece_codec.decode(sentencepiece_codec.encode(odd, MODEL, ids="salt"), MODEL, ids="salt", text="score")
    assert all((r["text"] or "") == r["score"] for r in rows.collect())
    assert sentencepiece_codec.piece_digests(none, MODEL).count() == 0


def test_disguises_do_not_depend_on_other_text():
    folds = pii.Folds()
    for text, kind, shown in (
        ("at eight.eight.eight.eight now", "ip", "eight.eight.eight.eight"),
        ("call plus 49 170 1234567 now", "phone", "plus 49 170 1234567"),
        ("call +49 170 12345 six seven now", "phone", "+49 170 12345 six seven"),
    ):
        for whole in (text, text + " a [dot] b", "x [at] y " + text):
            base, added = pii.spans(whole, folds)
            assert (kind, whole.index(shown), whole.index(shown) + len(shown)) in added, (whole, base, added)
    assert pii.spans("two plus 2 is four, 5 six and the rest", folds) == ([], [])


def plain_identifiers(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        total = sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out)


def test_identifiers_equal_plain_patterns(texts):
    rng = np.random.default_rng(3)
    made = ["".join(rng.choice(list("1234567890 .-+@()ab25"), rng.integers(5, 40))) for _ in range(20_000)]
    for text in [*texts, *made]:
        assert sorted(pii.identifiers(text)) == plain_identifiers(text)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john (at) example (dot) com now", "email", "john (at) example (dot) com"),
        ("john at example dot com", "email", "john at example dot com"),
        ("јоhn＠ехаmple．com", "email", "јоhn＠ехаmple．com"),
        ("call plus four nine one five one two three four five six seven!", "phone", "plus four nine one five one two three four five six seven"),
        ("ip 192[.]168[.]1[.]1", "ip", "192[.]168[.]1[.]1"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("+49​ 151 2345 6789", "phone", "+49​ 151 2345 6789"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    base, added = pii.spans(text, pii.Folds())
    assert not base and [(k, text[s:e]) for k, s, e in added] == [(kind, found)]


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("to jоhn.doe@example.com now", "email", "jоhn.doe@example.com"),
        ("to user@mail.exаmple.com now", "email", "user@mail.exаmple.com"),
        ("call +1 555 123 45 six seven eight now", "phone", "+1 555 123 45 six seven eight"),
        ("to bob [at] 10.0.0.1.example.com now", "email", "bob [at] 10.0.0.1.example.com"),
    ],
)
def test_a_base_span_does_not_hide_a_longer_disguise(text, kind, found):
    base, added = pii.spans(text, pii.Folds())
    assert base and base == pii.identifiers(text)
    assert [(k, text[s:e]) for k, s, e in added] == [(kind, found)]
    assert pii.masked(text, base + added) == text.replace(found, f"[{kind}]")


def test_a_covered_disguise_is_not_told_again():
    assert pii.spans("to a@b.de, c (at) d.org", pii.Folds()) == ([("email", 3, 9)], [("email", 11, 23)])


def test_prose_and_odd_rows_have_no_added_identifiers(spark, texts, odd, none):
    assert not any(pii.spans(t, pii.Folds())[1] for t in [*texts, "look at example.com dot", "one two three, at home"])
    assert pii.find(odd).count() == len(ODD) and pii.find(none).count() == 0
    assert pii.mask(spark.createDataFrame([(1, "x a@b.de y"), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()[0]["text"] == "x [email] y"


@pytest.mark.parametrize("digest", [exact_dedup.content_digest, lambda text: F.substring(F.unhex(F.sha2(text, 256)), 1, 0)])
def test_exact_groups_compare_content(odd, none, digest):
    """The second digest is the same for all texts, so only content tells them apart."""
    groups = {}
    for doc_id, text, *_ in ODD:
        groups.setdefault(text or "", []).append(doc_id)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((i, keep[t], len(ids), i == keep[t]) for t, ids in groups.items() for i in ids)
    rows = exact_dedup.exact_groups(odd, digest=digest).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows) == want
    left = exact_dedup.deduplicate(odd, digest=digest)
    assert left.columns == odd.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in left.collect()) == Counter((keep[t], t) for t in groups)
    assert exact_dedup.exact_groups(none).count() == 0


def test_shards(spark, odd, none):
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 1009)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer) if a != 6) < 1009 * 0.12
    # Slow reference: shards take turns at their whole permutations.
    number = lambda s, part: int(hashlib.md5(f"{part}:{s}".encode()).hexdigest()[:15], 16)
    orders = [iter([(number(s, "offset") + j * (number(s, "step") % 1008 + 1)) % 1009 for j in range(1009)]) for s in names]
    want, turn = {}, 0
    while len(want) < 1009:
        want[next(p for p in orders[turn % 7] if p not in want)] = turn % 7
        turn += 1
    assert [want[i] for i in range(1009)] == table
    rows = sharding.assign(odd, ["doc_id", "text"], names, 1009)
    assert rows.count() == len(ODD) and rows.columns.count("slot") == 1
    assert all(r["shard"] == names[table[r["slot"]]] for r in rows.collect())
    assert sharding.assign(none, ["doc_id"], names, 1009).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def all_cuts(vocabulary, logs, word):
    table = {vocabulary.pieces[i]: i for i in vocabulary.ids[vocabulary.ids >= 0]}
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, len(word) + 1):
        piece = word[:n]
        if piece in table:
            total += math.exp(logs[table[piece]]) * all_cuts(vocabulary, logs, word[n:])
        elif n == 1:
            total += math.exp(sum(logs[i] for i in vocabulary.spell_bytes(piece))) * all_cuts(vocabulary, logs, word[n:])
    return total


def test_lattice_sums_all_segmentations():
    vocabulary = Vocabulary(Path(MODEL).read_bytes())
    logs, words = lm_score.rank_weights(vocabulary), ["the", "then", "🎉a", "Xyz", "x" * 70]
    total = np.zeros(len(logs))
    found = lm_score.word_scores(vocabulary, logs, words, np.ones(len(words)), total)
    for word, value in zip(words[:4], found):
        assert math.isclose(math.exp(value), all_cuts(vocabulary, logs, "▁" + word), rel_tol=1e-9)
    lengths = np.array([len(p) for p in vocabulary.pieces], float)
    lengths[vocabulary.bytes] = 0.25  # the emoji is one character of four bytes
    assert math.isclose(float(total @ lengths), sum(len(w) + 1 for w in words), rel_tol=1e-9)


def test_language_model_scores(spark, odd, none):
    rows = connect(SF).execute("select doc_id, coalesce(text, '') from documents").fetchall()
    tokens = {i: [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), b"\n"] for i, t in rows}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    held = {True: [0.0, 0], False: [0.0, 0]}
    for r in queries.QUERIES["op6_lattice_score"](spark, SF).collect():
        ws = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        held[r["held_out"]][0] += r["score"]
        held[r["held_out"]][1] += len(ws)
    assert -7 < held[True][0] / held[True][1] < -3
    assert lm_score.score_documents(odd.drop("slot"), MODEL).count() == len(ODD)
    assert lm_score.score_documents(none, MODEL).count() == 0


def test_frequent_words_and_joined_words_score_alike(spark, odd, monkeypatch):
    def scores():
        rows = [*lm_score.score_documents(odd.drop("slot"), MODEL).collect()]
        return sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in rows)

    want = scores()
    monkeypatch.setattr(lm_score, "FREQUENT_BYTES", 3)  # longer words take the join
    assert scores() == want
    monkeypatch.setattr(lm_score, "FREQUENT", 2)
    assert scores() == want


def test_long_items_are_cut_between_windows():
    rng = np.random.default_rng(5)
    for n, block_words in ((1, 1), (3, 4), (10, 3), (4, 25)):
        words = [b"w%d" % i * int(rng.choice([1, 1, 40])) for i in range(60)]
        parts = [*decontamination.pieces(words, n, block_words)]
        assert len(parts) > 1
        windows = lambda ws: [tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))]
        assert [w for p in parts for w in windows(p)] == windows(words)
        assert all(len(p) == n or decontamination.size_of(p) <= block_words for p in parts)
    assert [*decontamination.pieces([], 10, 3)] == [[]] and [*decontamination.pieces([b"a"], 10, 3)] == [[b"a"]]


def test_decontamination_odd_rows_blocks_and_proximity(spark, odd, none):
    items = spark.createDataFrame([(1, "same words HERE"), (1, "id at"), (2, None), (None, "text same"), (3, "lorem ipsum dolor " * 5)], "item_id long, text string")
    want = {}
    for block_words in (100_000, 3):
        got = decontamination.contamination(odd, items, block_words=block_words).collect()
        rows = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got)
        assert sum(rows.values()) == len(ODD) and (not want or rows == want)
        want = rows
    hit = {(r[0], r[1]): (r[2], r[3]) for r in want}
    assert hit[(3, 60_000)] == (60_000, 1) and hit[(4, 7)] == (3, 1) and hit[(4, 4)] == (2, 1) and hit[(None, 5)] == (2, 1) and hit[(1, 0)] == (0, 0)
    assert decontamination.contamination(none, items).count() == 0
    assert decontamination.contamination(odd, items.filter("false")).filter("contaminated").count() == 0
    assert decontamination.clean(odd, items).columns == odd.columns
    apart = spark.createDataFrame([(1, "a b x c d"), (2, "a b x y c d"), (3, "d c b a")], "doc_id long, text string")
    phrase = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert [r["doc_id"] for r in decontamination.matches(apart, phrase, slop=1).collect()] == [1]


def test_word_hashes_tell_words_apart(texts):
    hashes, bounds = WordHasher().hashes(pa.array([*texts, "x" * 200_000 + " y"]))
    words = [t.encode().translate(WORD_SPACES).split() for t in [*texts, "x" * 200_000 + " y"]]
    assert np.diff(bounds).tolist() == [len(w) for w in words]
    assert len(set(hashes.tolist())) == len({w for ws in words for w in ws})


def test_draws_agree_as_weighted_jaccard():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 2**44, 2000, dtype=np.uint64))
    a = rng.random(2000).astype(np.float32) + 0.2
    b = a.copy()
    b[:600] = rng.random(600).astype(np.float32) * 2 + 0.05
    draws = near_dedup.Sampler(3000).draws(np.concatenate([keys, keys]), np.concatenate([a, b]), np.array([0, 2000, 4000]))
    assert abs((draws[0] == draws[1]).mean() - near_dedup.weighted_jaccard((keys, a), (keys, b))) < 0.03


def near_classes(documents):
    """The smallest id of each document's group, from all pairs."""
    rows = documents.orderBy("doc_id").collect()
    idf = near_dedup.inverse_frequencies(documents)
    hashes, bounds = WordHasher().hashes(pa.array([r["text"] for r in rows]))
    keys, weights, found = near_dedup.shingles(hashes, bounds, idf)
    vectors = [(keys[a:b], weights[a:b]) for a, b in zip(found, found[1:])]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near_dedup.weighted_jaccard(vectors[i], vectors[j]) >= 0.8:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for r, g in zip(rows, group):
        least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    return {r["doc_id"]: least[g] for r, g in zip(rows, group)}


def test_near_groups_equal_brute_force(spark, odd, none):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_groups(documents).collect()}
    assert got == near_classes(documents)
    assert len(set(got.values())) < len(got)
    classes = Counter((r["doc_id"], r["class_id"]) for r in near_dedup.near_groups(odd).collect())
    assert classes == Counter([(1, 1), (2, 1), (3, 3), (4, 4), (4, 4), (5, 4), (6, 6), (7, 7), (None, None), (4, 4), (8, 8)])
    assert near_dedup.deduplicate(odd).columns == odd.columns and near_dedup.deduplicate(odd).count() == 8
    assert near_dedup.near_groups(none).count() == 0


def test_near_links_that_no_leader_has(spark):
    """Chains whose ends share nothing, and variants of which many pairs are just above or below the threshold."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(words[5 * k : 5 * k + 200]) for k in range(60)]
    for base in range(3):
        first = rng.choice(words, 300).tolist()
        for _ in range(40):
            own = list(first)
            for at in rng.choice(300, rng.integers(4, 12), replace=False):
                own[at] = f"x{rng.integers(10**9)}"
            texts.append(" ".join(own))
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = near_classes(documents)
    assert all(want[k] == 0 for k in range(60)) and len(set(want.values())) > 3
    for block in (7, 1000):
        assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_groups(documents, block=block).collect()} == want


def test_chat_windows_read_back(spark):
    probe = "</s>[INST] ok [/INST]"
    hard = [
        (1, 0, "system", "be <|turn|> kind"), (1, 1, "user", "hi <|\\text|> <\\|end|>"), (1, 2, "assistant", "x " * 50), (1, 3, "user", None),
        (1, 4, "assistant", "<|end|><|turn|>assistant<|text|>no"), (1, 5, "user", "z " * 400), (1, 6, "assistant", ""), (1, 6, "assistant", "tie"),
        (-7, 0, "user", probe), (-7, 1, "assistant", probe), (None, 0, None, "\n"), (None, None, "assistant", "null turn"),
    ]
    rows = spark.createDataFrame(hard, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(rows, budget=120, history=30).withColumn("extra", F.lit(1))
    for r in windows.collect():
        assert r["n_tokens"] <= 120 or r["over_budget"]
        assert r["conv_id"] != 1 or "be <\\|turn|> kind" in r["text"]
    assert windows.filter("conv_id = 1").count() > 1
    want = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in (1, -7, None):
        own = sorted((r for r in hard if r[0] == c), key=key)
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        want[c] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.window_digests(windows).collect()}
    assert got == want
    assert chat.window_digests(chat.format_windows(rows.filter("false"))).count() == 0


def test_a_long_conversation_lies_in_many_parts(spark):
    turns = [(1, 0, "system", "be kind")] + [(1, i, ("assistant", "user")[i % 2], f"w{i} " * (i % 37)) for i in range(1, 600)]
    rows = spark.createDataFrame([*turns, (2, 0, "user", "a"), (None, 0, "user", "b")], "conv_id long, turn long, role string, text string")
    one = chat.format_windows(rows, budget=120, history=30).collect()
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        parts = chat.ordered_turns(rows).filter("conv_id = 1").select(F.shiftright("pos", 33)).distinct().count()
        many = chat.format_windows(rows, budget=120, history=30)
        assert parts > 1 and sorted(many.collect(), key=str) == sorted(one, key=str)
        streamed = chat.streamed_digests(spark.createDataFrame(one, many.schema))
        assert "collect_list" not in streamed._jdf.queryExecution().toString()
        whole = chat.window_digests(many)
        assert "Arrow" not in whole._jdf.queryExecution().executedPlan().toString()
        every = sorted(whole.collect(), key=str)
        assert every == sorted(streamed.collect(), key=str)
        assert every == sorted(chat.window_digests(many, limit=100).collect(), key=str)
        got = [r for r in every if r["conv_id"] == 1]
    finally:
        spark.conf.unset(setting)
    loss = "".join(t for *_, role, t in turns if role == "assistant")
    want = hashlib.sha256("".join(f"{role}\n{t}\n" for *_, role, t in turns).encode()).hexdigest()
    assert [(r["n_turns"], r["turns_sha256"], r["loss_chars"]) for r in got] == [(600, want, len(loss))]


def test_chat_query_equals_plain_reading(spark):
    con = connect(SF)
    turns = con.execute("select conv_id, role, coalesce(text, '') from conversations order by conv_id, turn").fetchall()
    turns += [(-7, "user", "</s>[INST] ok [/INST]"), (-7, "assistant", "</s>[INST] ok [/INST]")]
    lines, loss = {}, {}
    for c, role, text in turns:
        lines[c] = lines.get(c, "") + f"{role}\n{text}\n"
        loss[c] = loss.get(c, "") + (text if role == "assistant" else "")
    for r in queries.QUERIES["op9_chat_windows"](spark, SF).collect():
        assert r["turns_sha256"] == hashlib.sha256(lines.pop(r["conv_id"]).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss[r["conv_id"]].encode()).hexdigest() and r["loss_chars"] == len(loss[r["conv_id"]])
    assert not lines


def test_quality_gradients_and_held_out_accuracy(spark, odd, none):
    network = quality.Network()
    data, counts = quality.padded(pa.array(["some text here | and more ### " * 20, "", "short"]))
    labels = np.array([1, 0, 1], np.float32)
    gradients = network.gradients(data, counts, labels)

    def loss():
        p = network.scores(data, counts).astype(np.float64)
        return float(-(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean())

    for parameter, gradient in zip(network.parameters()[2:], gradients[2:]):
        for at in range(0, len(parameter), 7):
            before = parameter[at]
            parameter[at] = before + 1e-2
            up = loss()
            parameter[at] = before - 1e-2
            slope = (up - loss()) / 2e-2
            parameter[at] = before
            assert abs(slope - gradient[at]) < 2e-3
    # The convolution: the score by plain loops over filters, places and chunks, and slopes of table entries and biases.
    tables, bias, weights, offset = network.parameters()
    text = ("some text here | and more ### " * 20).encode()
    blocks = -(-(len(text) + quality.WIDTH) // quality.BLOCK)
    padded = text + bytes(blocks * quality.BLOCK + quality.WIDTH - len(text))
    out = [
        max(sum(float(tables[i, padded[p + i], f]) for i in range(quality.WIDTH)) for p in range(b * quality.BLOCK, (b + 1) * quality.BLOCK, quality.STEP))
        for b in range(blocks) for f in range(0, quality.FILTERS)
    ]
    best = np.maximum(np.array(out).reshape(blocks, quality.FILTERS) + bias, 0)
    chunks = np.maximum(best[:-1], best[1:])
    plain = 1 / (1 + np.exp(-(np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)]) @ weights + offset[0])))
    assert abs(float(network.scores(data, counts)[0]) - plain) < 1e-5
    for parameter, gradient, places in ((tables, gradients[0], [(i, b"s| "[i % 3], f) for i in range(8) for f in (0, 7, 31)]), (bias, gradients[1], range(0, 48, 5))):
        for at in places:
            before = parameter[at]
            parameter[at] = before + 1e-3
            up = loss()
            parameter[at] = before - 1e-3
            slope = (up - loss()) / 2e-3
            parameter[at] = before
            assert abs(slope - gradient[at]) < 5e-3
    rows = queries.QUERIES["op10_quality"](spark, "/root/testdata/sf0.01").collect()
    known = dict(connect("/root/testdata/sf0.01").execute("select doc_id, quality from labels").fetchall())
    held = [(r["predicted"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    assert sum(a == b for a, b in held) / len(held) > 0.93
    marks = spark.createDataFrame([(1, 1), (2, None), (4, 0), (4, 1), (None, 1), (99, 0)], "doc_id long, quality int")
    assert quality.classify(odd, marks).count() == len(ODD) and quality.classify(none, marks).count() == 0
    assert {r["score"] for r in quality.classify(odd, marks.filter("false")).collect()} == {0.5}
    assert quality.keep_good(odd, marks.filter("false")).columns == odd.columns


def test_the_network_travels_without_its_module(spark):
    import pickle

    values = pickle.dumps(quality.Network().parameters())
    assert b"sentrel" not in values and np.allclose(quality.Network.of(pickle.loads(values)).tables, quality.Network().tables)


def test_columns_of_any_name_stay(spark, odd):
    names = ["__key", "__digest", "__n", "__keep", "__node", "__text", "__score", "row", "key", "node", "digest", "Slot", "n", "a b", "probability"]
    wide = odd.select("doc_id", "text", *(F.concat(F.lit(f"{c}-"), F.coalesce("doc_id", F.lit(0))).alias(c) for c in names))
    wide = wide.withColumn("deep", F.struct(F.lit(1).alias("x y")))
    marks = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    benchmark = spark.createDataFrame([("q", "no such words anywhere")], "item_id string, text string")
    for left in (
        exact_dedup.deduplicate(wide),
        near_dedup.deduplicate(wide),
        decontamination.clean(wide, benchmark),
        quality.keep_good(wide, marks),
        quality.score(wide, quality.Network(), "__score").drop("__score").withColumn("__score", F.concat(F.lit("__score-"), F.coalesce("doc_id", F.lit(0)))),
        sharding.assign(wide, ["doc_id"], ["a", "b"]).drop("slot", "shard").withColumn("Slot", F.concat(F.lit("Slot-"), F.coalesce("doc_id", F.lit(0)))),
    ):
        rows = left.collect()
        assert rows and all(r[c] == f"{c}-{r['doc_id'] or 0}" and r["deep"]["x y"] == 1 for r in rows for c in names)


def test_piece_digests_equal_the_library_steps(spark):
    texts = dict(connect(SF).execute("select doc_id, coalesce(text, '') from documents").fetchall())
    vocabulary = Vocabulary(Path(MODEL).read_bytes())
    for r in queries.QUERIES["op2_sentencepiece"](spark, SF).orderBy("doc_id").limit(40).collect():
        words = [w.decode() for w in sentencepiece_codec.UNIT.findall(b" " + texts[r["doc_id"]].encode())] if texts[r["doc_id"]] else []
        ids, _ = sentencepiece_codec.segment(vocabulary, words)
        assert (r["n_pieces"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, SF)
        assert name == "sentencepiece" or kept.columns == docs.columns
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        kept = kept.cache()
        assert {r["doc_id"] for r in kept.select("doc_id").collect()} <= before
        if name in ("exact_dedup", "near_dedup"):
            assert kept.select("text").distinct().count() == kept.count()
        docs = kept
    assert docs.filter("not exact").isEmpty() and docs.count() > 0


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1), (4, 0), (4, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("q", "no id at all here"), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    wide = odd.withColumns({"__key": F.lit("mine"), "row": F.lit("own"), "node": F.lit(7)})
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, wide, str(tmp_path))
        rows = kept.collect()
        assert stage(spark, wide.filter("false"), str(tmp_path)).count() == 0 and rows
        if name == "sentencepiece":
            assert len(rows) == len(ODD) and all(r["exact"] for r in rows)
            continue
        assert kept.columns == wide.columns and all((r["__key"], r["row"], r["node"]) == ("mine", "own", 7) for r in rows)
        texts = [r["text"] for r in rows]
        if name == "exact_dedup":
            assert len(texts) == len({t or "" for t in texts}) == len({t or "" for _, t, *_ in ODD})
        if name == "decontamination":
            assert "no id at all here" not in texts and len(texts) == len(ODD) - 1
    assert stage(spark, none, str(tmp_path)).count() == 0


def test_pipeline_run_keeps_what_its_stages_keep(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    texts = dict(connect(SF).execute("select doc_id, coalesce(text, '') from documents").fetchall())
    kept = [r["doc_id"] for r in rows]
    assert len(set(kept)) == len(kept) and len({texts[i] for i in kept}) == len(kept) and all(r["exact"] for r in rows)
    contaminated = {r["doc_id"] for r in queries.QUERIES["op7_decontamination"](spark, SF).filter("contaminated").collect()}
    bad = {r["doc_id"] for r in queries.QUERIES["op10_quality"](spark, SF).filter("predicted = 0").collect()}
    classes = {r["doc_id"]: r["class_id"] for r in queries.QUERIES["op8_near_dedup"](spark, SF).collect()}
    assert not set(kept) & (contaminated | bad) and len({classes[i] for i in kept}) == len(kept)
    # Whoever goes is rejected, contaminated, or has a copy among those that stayed or went for such a reason.
    assert all(i in bad or i in contaminated or sum(classes[j] == classes[i] for j in texts) > 1 for i in texts if i not in set(kept))
