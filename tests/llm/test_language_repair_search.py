"""Language identification, conversation repair and ranked search against plain versions, and their edge cases."""

import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motorlens.llm import op11_language, op12_repair, op13_ranked
from motorlens.llm.op8_toxicity import _bytes
from motorlens.llm.store import saved

# ---------------------------------------------------------------- language


def naive_bits(text: bytes, counts: dict, tree: set, order: int) -> float:
    """Code length of one text: ``counts[context]`` has how often each byte followed it; contexts are the bytes before, in order."""
    total = 0.0
    for i, byte in enumerate(text):
        context = b""
        for k in range(1, order + 1):
            if k > i or text[i - k : i] not in tree:
                break
            context = text[i - k : i]
        out = set()
        while True:
            own = {b: n for b, n in counts.get(context, {}).items() if b not in out}
            n, d = sum(own.values()), len(own)
            if byte in own:
                total += math.log2((n + d) / own[byte])
                break
            if n:
                total += math.log2((n + d) / d)
            out |= own.keys()
            if not context:
                total += math.log2(256 - len(out))
                break
            context = context[1:]
    return total


def test_code_lengths_against_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(op11_language, "STEP", 61)
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 7)))
    made = {"x": "abcé", "y": "bcdü", "z": "aab"}
    rows = [(i, " ".join(word(made[lang]) for _ in range(12)), lang) for i, lang in enumerate(rng.choices(list(made), k=60))]
    docs = spark.createDataFrame(rows + [(100, None, "x"), (None, "never learned", "q"), (101, "no language", None)], "doc_id long, text string, lang string").repartition(3)
    model = op11_language.train(docs, nodes=150)
    assert model.languages == ["x", "y", "z"]
    learned = [(t.encode(), lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    counts: dict = {lang: {} for lang in made}
    for text, lang in learned:
        for i, byte in enumerate(text):
            for k in range(min(i, op11_language.ORDER) + 1):
                own = counts[lang].setdefault(text[i - k : i], {})
                own[byte] = own.get(byte, 0) + 1
    totals = {}
    for own in counts.values():
        for c, n in own.items():
            totals[c] = totals.get(c, 0) + sum(n.values())
    tree = set(sorted(totals, key=lambda c: (-totals[c], len(c), int.from_bytes(c, "big")))[:150])
    assert len(model.child) == 151 + 1
    texts = ["", "a", *(t for _, t, _ in rows[:25]), "Zß unknown bytes ab ab", rows[0][1] * 9]
    got = model.bits(*_bytes(pa.array(texts)))
    for text, bits in zip(texts, got):
        for lang, b in zip(model.languages, bits):
            kept = {c: n for c, n in counts[lang].items() if c in tree}
            assert b / op11_language.UNIT == pytest.approx(naive_bits(text.encode(), kept, tree, op11_language.ORDER), abs=1e-5 * (len(text) + 1))
    alone = np.concatenate([model.bits(*_bytes(pa.array([t]))) for t in texts])
    assert (alone == got).all()


def test_languages_of_held_out_rows_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = op11_language.train(docs, rows=50)
    found = op11_language.identified(docs.withColumn("score", F.lit("clash")), model).join(docs.select("doc_id", "lang"), "doc_id").where(op11_language.held_out()).toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.97 and found.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !?"), (4, "der die das und nicht"), (4, "der die das und nicht"), (None, "le la les des une"), (5, "le la les des une " * 40_000)], "doc_id long, text string")
    got = op11_language.identified(odd, model).collect()
    by = {(r["doc_id"], r["lang_pred"]) for r in got}
    assert len(got) == 7 and by == {(1, "und"), (2, "und"), (3, "und"), (4, "de"), (None, "fr"), (5, "fr")}
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert op11_language.identified(odd.limit(0), model).count() == 0
    nothing = op11_language.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in op11_language.identified(odd, nothing).collect()} == {"und"}


# ---------------------------------------------------------------- conversations


def plain_edits(rows):
    """(cost, initials, repaired rows) by trying every edit of each row. ``rows``: (role, text, gone, cut)."""

    @functools.cache
    def best(i, state, inserts):
        out = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        turn = ("assistant", "a") if state == "u" else ("user", "u")
        if inserts < 2:
            c, t, r = best(i, turn[1], inserts + 1)
            out.append((c + 2, "I" + t, (f"{turn[0]}:", *r)))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            c, t, r = best(i + 1, state, 0)
            out.append((c + 3, "D" + t, r))
            if not gone:
                c, t, r = best(i + 1, turn[1], 0)
                out.append((c + 2 + cut, "R" + t, (f"{turn[0]}:{text}", *r)))
                if role[:1] == turn[1] or role[:1] == "s" and state == "":
                    c, t, r = best(i + 1, role[:1], 0)
                    out.append((c + cut, "K" + t, (f"{role}:{text}", *r)))
        return min(out) if out else (10**9, "", ())

    return best(0, "", 0)


def plain_repair(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rows:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            cut = bool(bare) and bare[-1] not in ".!?"
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if cut else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            judged.append((role, text, fault in ("blank", "duplicate"), cut))
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit, lines = plain_edits(tuple(judged)) if rows else (0, "", ())
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


CHATS = "conv_id long, turn long, role string, text string"


def test_repair_against_trying_all_edits(spark):
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "agent", "", None, "User"], ["Hello.", "Why?", "cut off", " \n\t", "", None, "é!\n", "same.", "a.b"]
    table = [(c if c % 13 else None, rng.choice([None, *range(-2, 9)]), rng.choice(roles[: 3 + 5 * (c % 3 == 0)]), rng.choice(texts[: 3 + 6 * (c % 2)])) for c in range(120) for _ in range(rng.randrange(1, 7))]
    table += table[::9]
    rows = spark.createDataFrame(table, CHATS).withColumns({c: F.lit("x") for c in ("h", "copies", "mark", "cost", "signature")}).repartition(5)
    got = op12_repair.repair(rows).collect()
    want = plain_repair(table)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]], r


def test_repair_of_long_and_empty_conversations(spark):
    long = [(1, t, ["user", "assistant"][t % 2], "x" * 50_000 + f"{t}.") for t in range(30)]
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    many = spark.range(5000).selectExpr("CAST(NULL AS LONG) AS conv_id", "CAST(NULL AS LONG) AS turn", "'user' AS role", "concat('t', id % 700, '.') AS text")
    got = {r["conv_id"]: r for r in op12_repair.repair(spark.createDataFrame([*long, (dropped, 0, "user", "gone.")], CHATS).unionByName(many)).collect()}
    assert tuple(got[dropped])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert tuple(got[1])[1:] == plain_repair(long)[1]
    kind = zlib.crc32(b" : ") % 20
    assert kind > 4 and got[None]["duplicate"] == 4300 and got[None]["illegal"] == 4999 and len(got[None]["audit"]) >= 5000
    assert op12_repair.repair(many.limit(0)).count() == 0


def test_layers_are_shared_between_words():
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("suaoSUAOD") for _ in range(rng.randrange(0, 9))) for _ in range(3000)})
    branch = op12_repair.Branch()
    roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for word in words:
        rows = tuple((roles.get(x.lower(), ""), "", x == "D", x in "SUAO") for x in reversed(word))
        assert branch.solve(word) == plain_edits(rows)[:2]
    prefixes = {w[:i] for w in words for i in range(1, len(w) + 1)}
    assert branch.made == len(prefixes) < sum(map(len, words)) / 1.5


# ---------------------------------------------------------------- search


def plain_ranking(docs, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    own = [(d, split(t)) for d, t in docs]
    own = [(d, t) for d, t in own if t]
    n, all_terms = len(own), sum(len(t) for _, t in own)
    asked: dict = {}
    for i, t in items:
        if t is not None:
            asked.setdefault(i, set()).update(split(t))
    out = []
    for item, query in asked.items():
        found = []
        for d, t in own:
            score = 0
            for term in query & set(t):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * sum(term in x for _, x in own) + 1)))
                tf, m = t.count(term), 100 - 90 + 90 * len(t) * n // all_terms
                score += w * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block, seeds, queries", [(4, 1, 5), (64, 8, 4096), (3, 2, 4096)])
def test_ranking_against_all_scores(spark, monkeypatch, block, seeds, queries):
    monkeypatch.setattr(op13_ranked, "BLOCK", block)
    monkeypatch.setattr(op13_ranked, "SEEDS", seeds)
    monkeypatch.setattr(op13_ranked, "GROUP", 7)
    monkeypatch.setattr(op13_ranked, "SPAN", 40)
    rng = random.Random(block)
    word = lambda: "wé" + str(min(rng.randrange(1, 40), rng.randrange(1, 40))) + rng.choice(["", "", "X"])
    docs = [(rng.choice([None, *range(-5, 90)]), " ,".join(word() for _ in range(rng.randrange(0, 60)))) for _ in range(140)] + [(7, None), (8, ""), (9, "--- !!"), (10, "wé1 " * 3000)]
    docs += docs[:20] + [(1000 + i, "wé1 wé2 wé3") for i in range(30)]
    items = [(i if i % 9 else None, " ".join(word() for _ in range(rng.randrange(0, 9)))) for i in range(12)] + [(3, "wé1 wé1 other"), (50, None), (51, "nobodyhasit"), (52, ";;")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "term", "block", "score", "rank")}).repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("query", "part", "rank")})
    got = sorted((tuple(r) for r in op13_ranked.ranked(table, asked, queries=queries).collect()), key=str)
    assert got == plain_ranking(docs, items)
    assert op13_ranked.ranked(table.limit(0), asked).count() == 0 and op13_ranked.ranked(table, asked.limit(0)).count() == 0


def test_blocks_below_the_threshold_are_not_scored(spark):
    """Few blocks hold what a query asks for; the others' bounds stay below the k-th score."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('common word', IF(id % 1000 < 20, concat(' rare', id div 1000), ' x'), ' y', id % 7) AS text")
    items = spark.createDataFrame([(i, f"common word rare{i}") for i in range(20)], "item_id long, text string")
    ids, own, words = op13_ranked.vocabulary(items)
    index = saved(op13_ranked.forward_index(docs, words), "t")
    n, all_terms, df = op13_ranked.statistics(index, len(words))
    made = saved(op13_ranked.blocks(index, n, all_terms), "t")
    query = op13_ranked.Query(own, op13_ranked.weights(n, df), len(words))
    found = made.coalesce(1).mapInArrow(op13_ranked._searched(query, 10, np.zeros(20), report=True), "pairs long, scored long").toPandas()
    assert found.pairs.sum() >= 20 * 20_000 / 64 and found.scored.sum() < found.pairs.sum() / 20
