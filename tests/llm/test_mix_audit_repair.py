"""Source audit, source mix and turn repair: odd rows, and against plain recomputation."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from conftest import DATA, assert_same
from pyspark.sql import functions as F

from rosterspark.llm import queries, source_audit, source_mix, turn_repair
from rosterspark.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, passes int, at string"


def test_audit_agrees_with_sql(spark, duck):
    assert_same(queries.op11_source_audit(spark, DATA), duck, queries.OP11_SQL)


def test_mix_agrees_with_sql(spark, duck):
    assert_same(queries.op12_source_mix(spark, DATA), duck, queries.OP12_SQL)


def odd_documents(spark):
    texts = [None, "", " \t", "Alpha beta", "alpha BETA gamma", "ünï Alpha", "x" * 50_000 + " alpha"]
    rows = [(k if k else None, t, [None, "en", ""][k % 3], [None, "a", "b", ""][k % 4], 1, 7, "y") for k, t in enumerate(texts * 3)]
    return spark.createDataFrame([*rows, rows[3], rows[3]], DOCS), [*rows, rows[3], rows[3]]


def plain_audit(rows, least_docs, top):
    """The audit by its definition, with Python's integers."""
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {x[0] for x in words}:
        own = [x for x in words if x[0] == lang]
        docs = Counter(t for _, _, ts in own for t in set(ts))
        kept = {t for t, k in docs.items() if k >= least_docs}
        counts = {s: Counter(t for _, x, ts in own if x == s for t in ts if t in kept) for s in {x[1] for x in own}}
        every = sum(counts.values(), Counter())

        def share(c):
            whole = sum(c.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // whole for t in kept}

        q = share(every)
        for s, c in counts.items():
            p = share(c)
            pairs = [(o, sum(abs(p[t] - share(d)[t]) for t in kept)) for o, d in counts.items() if o != s]
            terms = [(t, p[t] - q[t]) for t in kept if c[t] > 0 and p[t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


@pytest.mark.parametrize("least_docs", [1, 4, 99])
def test_audit_of_odd_rows(spark, least_docs):
    docs, rows = odd_documents(spark)
    assert sorted(map(tuple, source_audit.audit(docs, least_docs, 2).collect())) == plain_audit(rows, least_docs, 2)
    assert source_audit.audit(docs.limit(0)).count() == 0


def test_audit_in_many_small_tiles(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(f"w{chr(97 + rng.randrange(20))}{chr(97 + rng.randrange(3))}" for _ in range(20)), "en", f"s{rng.randrange(7)}", 0, 0, "") for k in range(120)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    kept = source_audit.kept_counts(docs, 3)
    groups = source_audit.source_groups(kept)
    small, large = (source_audit.tiles(kept, groups, 4, *size) for size in ((5, 2), (4096, 256)))

    def pairs(df):
        return sorted(map(tuple, df.where("j IS NOT NULL").groupBy("i", "j").agg(F.sum("value")).collect()))

    assert pairs(small) == pairs(large) and len(pairs(large)) == 21
    assert sorted(map(tuple, source_audit.audit(docs, 3, 4).collect())) == plain_audit(rows, 3, 4)
    # Counts are written in parts as well when a task holds many.
    parts = source_audit.count_terms(docs, 10).groupBy("source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    whole = source_audit.count_terms(docs).groupBy("source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    assert parts.exceptAll(whole).count() == 0 == whole.exceptAll(parts).count()


def test_shares_stay_exact_beyond_63_bits():
    counts, words = np.array([[10**12, 0, 123_456_789_012]]), 9 * 10**14
    whole = words + 5 * 3
    assert source_audit.shares(counts, np.array([[words]]), 3).tolist() == [[1 + 10**9 * (int(c) + 5) // whole for c in counts[0]]]


def plain_targets(sizes: dict) -> dict:
    """Share by weight, stop at twice the size, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, budget, free = dict.fromkeys(names, Fraction(0)), Fraction(3, 2) * sum(sizes.values()), set(names)
    while budget > 0 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += budget * weight[s] / total
        budget = sum(max(0, target[s] - 2 * sizes[s]) for s in names)
        for s in list(free):
            if target[s] >= 2 * sizes[s]:
                target[s] = Fraction(2 * sizes[s])
                free.discard(s)
    return {s: float(t) for s, t in target.items()}


def test_mix_of_odd_rows(spark):
    docs, rows = odd_documents(spark)
    found = source_mix.mix_plan(docs).collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for _, text, _, source, *_ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = plain_targets(sizes)
    assert sorted({(r["source_size"], round(r["target"], 6)) for r in found}) == sorted({(sizes[s], round(t, 6)) for s, t in want.items()})
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) and r["taken"] == r["times"] * r["size"] for r in found)
    assert source_mix.mix_plan(docs.limit(0)).count() == 0
    mixed = source_mix.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["times"] for r in found)


def test_mix_comes_near_its_targets_and_is_nested(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    found = source_mix.mix_plan(docs).join(docs.select("doc_id", "source"), "doc_id")
    sums = found.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size"), F.first("source_size").alias("source_size")).collect()
    assert {r["source"]: round(r["target"], 3) for r in sums} == {s: round(t, 3) for s, t in plain_targets({r["source"]: r["size"] for r in sums}).items()}
    assert all(abs(r["taken"] - r["target"]) <= 3 and r["size"] == r["source_size"] for r in sums)
    again = source_mix.mix_plan(docs.repartition(7)).select("doc_id", "taken")
    assert again.exceptAll(found.select("doc_id", "taken")).count() == 0
    less = source_mix.mix_plan(docs, share=0.7).where("times > 0").select("doc_id")
    assert less.exceptAll(found.where("times > 0").select("doc_id")).count() == 0


def plain_repair(rows):
    """One conversation's report by one pass over its rows: (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    after = {0: "u", 1: "u", 2: "a", 3: "u"}
    best = {0: (0, "", ())}

    def move(state, letter):
        if letter == "s":
            return 1 if state == 0 else None
        return {"u": 2, "a": 3}[letter] if letter in "ua" and after[state] == letter else None

    def offer(into, state, cost, audit, said):
        if state is not None and (state not in into or (cost, audit) < into[state][:2]):
            into[state] = (cost, audit, said)
            return True
        return False

    def inserted(states):
        changed = True
        while changed:
            changed = False
            for s, (cost, audit, said) in list(states.items()):
                role = {"u": "user", "a": "assistant"}[after[s]]
                changed |= offer(states, move(s, after[s]), cost + 3, audit + "I", (*said, (role, "")))
        return states

    for (_, role, text), fault in zip(rows, faults, strict=True):
        following = {}
        for s, (cost, audit, said) in inserted(best).items():
            offer(following, s, cost + 4, audit + "D", said)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                other = {"u": "user", "a": "assistant"}[after[s]]
                offer(following, move(s, role[:1]) if role else None, cost + more, audit + "K", (*said, (role, text)))
                offer(following, move(s, after[s]), cost + more + 3, audit + "R", (*said, (other, text)))
        best = following
    ends = [v for s, v in inserted(best).items() if s in (0, 3)]
    cost, audit, said = min(ends, key=lambda v: v[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
    return gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha


def plain_reports(rows):
    """All reports of (conv_id, turn, role, text) after the damage."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        found[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return sorted(((conv, *plain_repair(sorted(own, key=order))) for conv, own in found.items()), key=repr)


def reports_of(df):
    return sorted(map(tuple, turn_repair.reports(turn_repair.repair(turn_repair.damaged(df))).collect()), key=repr)


def test_repair_of_all_conversations(spark):
    df = table(spark, DATA, "conversations")
    assert reports_of(df) == plain_reports([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("parts", ["1", "3", "150"])
def test_repair_of_odd_and_long_conversations(spark, parts):
    rng, roles = random.Random(11), ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    texts = ["Yes.", "No", "", " \n", None, "Why?", "é!", "Well. so", "a" * 3000 + "."]
    rows = [(1, t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"say {t}.") for t in range(0, 900, 2)]
    rows += [(c, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(roles), rng.choice(texts)) for c in (None, 2, 3, 4, 5) for _ in range(9)]
    rows += [(6, 1, "user", "Hi.")] * 5 + [(7, None, None, None)] + [(c, 0, "user", "Hi.") for c in range(100, 140)]
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], "conv_id long, turn long, role string, text string, chunk int, part string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert reports_of(df.repartition(5)) == plain_reports(rows)
        out = turn_repair.repair(turn_repair.damaged(df))
        kept = turn_repair.repaired_turns(out).where("conv_id = 1").orderBy("chunk", "place").collect()
        report = next(r for r in turn_repair.reports(out).collect() if r["conv_id"] == 1)
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in kept).encode()).hexdigest() == report["repaired_sha256"]
        assert "".join(r["edit"] for r in kept) == report["audit"].replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in kept))
        assert reports_of(df.limit(0)) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_cheapest_edits_against_all_edits():
    """Every edit list with up to two insertions in a gap, of every short conversation."""
    from itertools import product

    gaps = ["", "I", "II"]
    for size in range(4):
        for turns in product([("u", ""), ("a", "truncated"), ("s", ""), ("x", "truncated"), ("u", "duplicate")], repeat=size):
            best = None
            for edits in product("KRD", repeat=size):
                for put in product(gaps, repeat=size + 1):
                    audit = put[0] + "".join(e + p for e, p in zip(edits, put[1:], strict=True))
                    state, cost, k = 0, 0, 0
                    for e in audit:
                        if e == "I":
                            cost, letter = cost + 3, "a" if state == 2 else "u"
                        else:
                            own, fault = turns[k]
                            k += 1
                            if e == "D":
                                cost += 4
                                continue
                            if fault == "duplicate":
                                state = -1
                                break
                            cost += 3 * (fault == "truncated") + 3 * (e == "R")
                            letter = own if e == "K" else "a" if state == 2 else "u"
                        state = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((letter, state), -1)
                        if state < 0:
                            break
                    if state in (0, 3) and (best is None or (cost, audit) < best):
                        best = (cost, audit)
            own = [turn_repair.turn_matrix(*t) for t in turns]
            assert turn_repair.cheapest(turn_repair.product(own) if own else turn_repair.insertions())[:2] == best
