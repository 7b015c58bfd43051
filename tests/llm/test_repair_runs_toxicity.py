"""Conversation repair, periodic runs and toxic passages against brute force, held-out rows and odd inputs."""

import hashlib
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sentrel.llm import conversation_repair as repair
from sentrel.llm import periodic_runs, queries, toxicity
from tests.compare import connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
WHITE = " \t\n\x0b\x0c\r"


# --- Conversation repair ---------------------------------------------------------


def cheapest(rows):
    """Cost, letters and repaired rows of the best of all edits of (role, text, fault), tried one by one."""
    best = None

    def tried(i, out, cost, letters, inserted):
        nonlocal best
        if cost > (best[0] if best else 2 * len(rows)):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(role[:1] for role, _ in out)):
            found = (cost, letters, out)
            best = found if best is None else min(best, found, key=lambda x: x[:2])
        if inserted < 2:
            for role in ("user", "assistant"):
                tried(i, [*out, (role, "")], cost + 5, letters + "I", inserted + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            tried(i + 1, out, cost + 2, letters + "D", 0)
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                tried(i + 1, [*out, (role, text)], cost + more, letters + "K", 0)
                for new in ("user", "assistant"):
                    tried(i + 1, [*out, (new, text)], cost + more + 1, letters + "R", 0)

    tried(0, [], 0, "", 0)
    return best


def by_table(rows):
    """The same by a table of (cost, letters) per state, for conversations of any length; letters compare as texts."""
    states = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    far = (1 << 40, "")

    def inserted(costs):
        for _ in range(2):
            costs = {s: min([costs[s], *((costs[t][0] + 5, "I" + costs[t][1]) for r, t in states[s].items() if r != "s")]) for s in states}
        return costs

    costs = inserted({s: (0, "") if s in ("", "a") else far for s in states})
    for role, _, fault in reversed(rows):
        now = {}
        for s in states:
            found = [(costs[s][0] + 2, "D" + costs[s][1])]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1] in states[s]:
                    c = costs[states[s][role[:1]]]
                    found.append((c[0] + more, "K" + c[1]))
                found += [(costs[t][0] + more + 1, "R" + costs[t][1]) for r, t in states[s].items() if r != "s"]
            now[s] = min(found)
        base = now
        for _ in range(2):
            now = {s: min([base[s], *((now[t][0] + 5, "I" + now[t][1]) for r, t in states[s].items() if r != "s")]) for s in states}
        costs = now
    return costs[""]


def in_chunks(pairs, size):
    chunks = [pairs[i : i + size] for i in range(0, len(pairs), size)]
    state, letters, cost = 0, "", None
    for chunk, behind in zip(chunks, repair.costs_behind([repair.matrix(c) for c in chunks])):
        path = repair.best_paths(chunk, behind)[state]
        cost = path[0] if cost is None else cost
        letters += path[1]
        state = repair.walked(chunk, path[1], state)
    return cost, letters + repair.closing(state)


@pytest.mark.parametrize("dear", [5, 1])
def test_weights_find_the_cheapest_edits(monkeypatch, dear):
    rng = random.Random(dear)
    roles, faults = ["system", "user", "assistant", "tool", "user", "assistant"], ["", "", "", "truncated", "blank", "duplicate"]
    for _ in range(150):
        rows = [(rng.choice(roles), str(i), rng.choice(faults)) for i in range(rng.randint(1, 5))]
        if dear == 5:
            assert in_chunks([(r[:1], f) for r, _, f in rows], 2) == by_table(rows) == cheapest(rows)[:2]
    monkeypatch.setattr(repair, "INSERT", dear)  # cheap insertions are used, and chunks still agree with one piece
    for _ in range(150):
        pairs = [(rng.choice(roles)[:1], rng.choice(faults)) for _ in range(rng.randint(1, 40))]
        whole = in_chunks(pairs, 100)
        assert all(in_chunks(pairs, n) == whole for n in (1, 3, 7))
        assert dear == 1 or whole == by_table([(r, "", f) for r, f in pairs])


def expected_report(turns):
    """The whole report of one conversation, rows of (turn, role, text) after damage, by plain Python."""
    rows, seen = [], set()
    for _, role, text in turns:
        bare = text.strip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        rows.append((role, text, fault))
    numbers = [t for t, *_ in turns if t is not None]
    initials = [r[:1] for r, *_ in rows]
    counts = [max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0]
    counts += [sum(f == kind for *_, f in rows) for kind in ("blank", "duplicate", "truncated")]
    counts.append(sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])))
    cost, audit = by_table(rows) if rows else (0, "")
    state, out, at = "", [], 0
    for letter in audit:
        role, text, _ = rows[at] if letter != "I" else ("", "", "")
        at += letter != "I"
        if letter == "D":
            continue
        if letter in "IR":
            role = "assistant" if state == "u" else "user"
        state = role[:1]
        out.append(f"{role}:{text}")
    return (*counts, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damaged(conv_id, turns):
    out = []
    for turn, role, text in turns:
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


SHOWN = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_query_equals_plain_python(spark):
    conversations = {}
    for conv_id, turn, role, text in connect(SF).execute("select conv_id, turn, role, text from conversations").fetchall():
        conversations.setdefault(conv_id, []).append((turn, role, text))
    rows = queries.QUERIES["op11_conversation_repair"](spark, SF).collect()
    assert {r["conv_id"]: tuple(r[c] for c in SHOWN) for r in rows} == {c: expected_report(damaged(c, t)) for c, t in conversations.items()}
    assert len(rows) == len(conversations)


@pytest.fixture
def hard_turns():
    rng = random.Random(4)
    long = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "", f"c{i}!", f"d{i}"])) for i in range(3000)]
    odd = [
        (2, None, "user", "first."), (2, None, None, None), (2, 5, "user", "x."), (2, 5, "user", "x."), (2, 9, "assistant", "long " * 20_000),
        (None, 0, "user", "hi."), (None, 1, "assistant", "yo."), (3, 0, "system", "only."), (4, 0, "", "no role."), (5, None, "user", "a\u2003"),
    ]
    return long + odd


def test_odd_conversations(spark, tmp_path, hard_turns):
    rows = spark.createDataFrame(hard_turns, "conv_id long, turn long, role string, text string")
    rows = rows.withColumns({"pos": F.lit("mine"), "conv": F.lit(0), "letters": F.lit("x")})
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        got = {r["conv"]: tuple(r[c] for c in SHOWN) for r in repair.report(rows).collect()}
        turns = repair.repair(rows).collect()
    finally:
        spark.conf.unset(setting)
    by_id = {}
    for conv_id, turn, role, text in hard_turns:
        by_id.setdefault(conv_id, []).append((turn, " " if role is None else role, " " if text is None else text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    want = {"" if c is None else f"={c}": expected_report(sorted(t, key=order)) for c, t in by_id.items()}
    assert got == want
    for conv_id in by_id:
        own = sorted((r["n"], f"{r['role']}:{r['text']}") for r in turns if r["conv_id"] == (None if conv_id is None else str(conv_id)))
        assert [n for n, _ in own] == list(range(len(own)))
        key = "" if conv_id is None else f"={conv_id}"
        assert hashlib.sha256("\n".join(x for _, x in own).encode()).hexdigest() == want[key][-1]
    assert repair.report(rows.filter("false")).count() == 0 and repair.repair(rows.filter("false")).count() == 0
    # All rows of a conversation may be lost to damage.
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(lost, 0, "user", "gone.")], rows.schema.names[:4]).write.parquet(f"{tmp_path}/conversations.parquet")
    row = queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path)).first()
    assert tuple(row[c] for c in SHOWN) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# --- Periodic runs -----------------------------------------------------------------


def plain_runs(words):
    """All runs by a comparison at each period."""
    codes = {}
    a, out = np.array([codes.setdefault(w, len(codes)) for w in words], np.int64), []
    for q in range(1, len(a) // 3 + 1):
        change = np.diff(np.concatenate([[0], (a[:-q] == a[q:]).astype(int), [0]]))
        for start, stop in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()):
            length = stop + q - start
            own = a[start : start + length]
            if length >= max(24, 3 * q) and not any((own[:-d] == own[d:]).all() for d in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_a_comparison_at_each_period():
    rng, n = random.Random(7), 0
    for _ in range(250):
        documents = []
        for _ in range(rng.randint(1, 4)):
            letters = rng.choice([1, 2, 2, 3, 5, 20])
            some = lambda k: [b"%d" % rng.randrange(letters) for _ in range(k)]  # noqa: B023, E731
            words = some(rng.randint(0, 60))
            for _ in range(rng.randint(0, 3)):
                unit = some(rng.randint(1, 40))
                unit = unit * rng.randint(1, 3) + some(1) if rng.random() < 0.3 else unit
                words += unit * rng.randint(2, 6) + unit[: rng.randint(0, len(unit))] + some(rng.randint(0, 10))
            documents.append(words)
        found = periodic_runs.find_runs(*periodic_runs.numbered(documents)).tolist()
        for i, words in enumerate(documents):
            want = plain_runs(words)
            assert [tuple(r[1:]) for r in found if r[0] == i] == want
            n += len(want)
    assert n > 500
    # Every long k-gram of this unit comes twice in it.
    p, q = ([b"%d-%d" % (x, i) for i in range(20)] for x in range(2))
    words = (p * 3 + q * 3 + p + q) * 4
    assert [tuple(r[1:]) for r in periodic_runs.find_runs(*periodic_runs.numbered([words])).tolist()] == plain_runs(words)
    assert periodic_runs.find_runs(*periodic_runs.numbered([[b"a"] * 100_000])).tolist() == [[0, 0, 100_000, 1]]


def test_runs_query_equals_plain_python(spark):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    documents = connect(SF).execute("select doc_id, coalesce(text, '') from documents").fetchall()
    assert len(rows) == len(documents)
    seen = 0
    for doc_id, text in documents:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if n and h % 10 == 0:
            a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue
        runs, row = plain_runs(words), rows[doc_id]
        seen += bool(runs)
        lines = "".join("%d,%d,%d\n" % r for r in runs)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        left = " ".join(w for i, w in enumerate(words) if i not in gone)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert tuple(row[c] for c in ("start", "length", "period", "exponent_milli")) == want and row["n_runs"] == len(runs)
        assert (row["runs_sha256"], row["collapsed_sha256"]) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (lines, left))
    assert seen > 10


def test_runs_of_odd_tables(spark):
    rows = [(1, None, 1), (1, "", 2), (None, "a b " * 30 + "c", 3), (2, "\u00a0x\u2003y " * 40, 4), (2, "\u00a0x\u2003y " * 40, 5), (3, "w " * 150_000, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumnRenamed("runs", "n_words").withColumn("a b", F.lit(1))
    found = periodic_runs.collapse(df).collect()
    got = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found), key=str)
    odd = (2, 40, [(0, 40, 1)], "\u00a0x\u2003y")
    assert got == sorted([(1, 0, [], ""), (1, 0, [], ""), (0, 61, [(0, 60, 2)], "a b c"), odd, odd, (3, 150_000, [(0, 150_000, 1)], "w")], key=str)
    assert found[0]["a b"] == 1 and periodic_runs.collapse(df.filter("false")).count() == 0


# --- Toxicity ----------------------------------------------------------------------


def plain_passages(scores):
    """The best stretch, then those of what lies on its left and right."""
    sums, best = np.concatenate([[0.0], np.cumsum(scores)]), (1e-9, 0, 0)
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            if sums[j] - sums[i] > best[0] + 1e-12:
                best = (sums[j] - sums[i], i, j)
    if not best[2]:
        return []
    _, i, j = best
    return plain_passages(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in plain_passages(scores[j:])]


def test_passages_are_the_maximal_ones():
    rng = np.random.default_rng(5)
    for _ in range(300):
        scores = rng.normal(-0.3, 1, rng.integers(0, 30))
        found = toxicity.passages(scores)
        assert [(a, b) for a, b, _ in found] == plain_passages(scores)
        assert all(abs(s - scores[a:b].sum()) < 1e-9 for a, b, s in found)
    many = np.tile([1.0, -0.5, 1.0, -2.0], 50_000)
    assert len(toxicity.passages(many)) == 50_000


def test_cells_and_law():
    tokens = toxicity.Tokens()
    cells, starts, ends, bounds = tokens.cells(pa.array(["Loser losers", "", "x loser"]))
    assert bounds.tolist() == [0, 2, 2, 4] and cells[0, 0] == cells[0, 3] and cells[1, 0] == cells[1, 1] and cells[0, 0] != cells[0, 1]
    assert [b"Loser losersx loser"[a:b] for a, b in zip(starts, ends)] == [b"Loser", b"losers", b"x", b"loser"]
    counts = np.zeros(toxicity.STEPS + 1)
    counts[0], counts[100] = 10_000, 10
    decay = toxicity.decay_of(counts)
    counts[100] += 1  # the one word of the greatest score that is added
    values = np.arange(len(counts)) * toxicity.STEP - toxicity.COST
    assert abs(float((counts / counts.sum()) @ np.exp(decay * values)) - 1) < 1e-6
    x, y = np.array([0, 0, 0, 1, 5, 6, 9, 0.5]), np.array([0, 0, 0, 0, 1, 1, 1, 1])
    offset, slope = toxicity.curve(x, y)
    p = toxicity.sigmoid(offset + slope * np.log1p(x))
    assert slope > 0 and abs((p - y).sum() + 0.01 * (offset - 0)) < 0.02


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op13_toxicity"](spark, folder).collect()
    con = connect(folder)
    assert len(rows) == con.execute("select count(*) from documents").fetchone()[0]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    known = dict(con.execute("select doc_id, toxic from labels").fetchall())
    held = [(r["predicted"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    toxic = [p for p, t in held if t]
    assert sum(toxic) / len(toxic) > 0.9 and sum(p for p, t in held if not t) / (len(held) - len(toxic)) < 0.03


def test_toxicity_of_odd_tables(spark):
    texts = [(i, "you filthy zork and " + "plain words here " * (i % 5 + 1)) for i in range(60)] + [(i, "plain words here and there " * (i % 5 + 1)) for i in range(60, 200)]
    rows = spark.createDataFrame([*texts, (None, "no id", ), (500, None), (501, ""), (7, texts[7][1]), (502, "\u00e9 zork " * 30_000)], "doc_id long, text string")
    rows = rows.withColumns({"toxic_score": F.lit("x"), "fold": F.lit(1), "toxic": F.lit(1), "a b": F.lit(2)})
    labels = spark.createDataFrame([*((i, int(i < 60)) for i in range(200)), (3, 0), (None, 1), (501, None)], "doc_id long, toxic int")
    model = toxicity.train(rows, labels)
    found = {r["doc_id"]: r for r in toxicity.find_passages(rows, model).collect()}
    assert "filthy" in texts[5][1][found[5]["toxic_passages"][0]["start"] : found[5]["toxic_passages"][0]["end"]]
    assert found[5]["toxic_score"] > 0.5 > 0.3 > found[100]["toxic_score"] and found[100]["toxic_passages"] == [] and found[5]["a b"] == 2
    assert found[500]["toxic_score"] == found[501]["toxic_score"] == found[100]["toxic_score"] and 0 <= found[502]["toxic_score"] <= 1
    assert toxicity.classify(rows, labels).count() == rows.count() and toxicity.classify(rows.filter("false"), labels).count() == 0
    assert max(r["score"] for r in toxicity.classify(rows, labels.filter("false")).collect()) < 1e-6
