"""The ten operators on odd inputs: nulls, empty and long texts, ties, repeats, empty
tables, clashing column names; and against brute force, round trips and held-out labels."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import DATA, assert_same
from pyspark.sql import functions as F

import corpus_pipeline
from rosterspark.llm import chat_format, decontaminate, line_dedup, near_dedup, packing, page_template, quality, queries, syncmers, token_store, tokens, toxicity
from rosterspark.llm.common import held_out, table

BYTE = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
WORD = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, band long, hash string, part int"


def rows(*texts):
    return [(i if i else None, t, None, f"s{i}", len(t or ""), i, "x", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    texts = ["of no id", None, "", " \n\t ", base, base, base + " thirteen", "word", "né ß 漢字 👍 <|im_end|>", "long " * 30_000 + base]
    return spark.createDataFrame([*rows(*texts), rows(*texts)[4]], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


def runs(spark, docs, labels):
    """Each operator's result for (name, docs)."""
    items = spark.createDataFrame([(1, "three four five six seven eight nine ten eleven twelve"), (2, None), (3, "")], "item_id long, text string")
    yield "quality", quality.score_documents(docs, quality.train(docs, labels))
    yield "toxicity", toxicity.score_documents(docs, toxicity.train(docs, labels))
    yield "near", near_dedup.near_duplicates(docs)
    yield "decontaminate", decontaminate.report(docs, items)
    yield "lines", line_dedup.remove_spread_lines(docs)
    yield "syncmers", syncmers.edited_fingerprints(docs)
    yield "tokens", token_store.store_and_read(docs, WORD)


def test_odd_rows(spark, odd, labels):
    n = odd.count()
    for name, out in runs(spark, odd, labels):
        assert out.count() == n, name
    pieces = packing.pack(odd, *BYTE).collect()
    assert sum(r["length"] for r in pieces) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)


def test_empty_tables(spark, odd, labels):
    for name, out in runs(spark, odd.limit(0), labels.limit(0)):
        assert out.count() == 0, name
    assert packing.pack(odd.limit(0), *BYTE).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert page_template.extract(pages).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.format_turns(turns)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, duck, name):
    assert_same(queries.queries()[name](spark, DATA), duck, queries.oracle_sql()[name])


def held_out_rows(spark, df, label):
    known = df.join(table(spark, DATA.replace("0.001", "0.1"), "labels"), "doc_id").where(F.col(label).isNotNull() & F.col("held_out"))
    return [(r["predicted"], r[label]) for r in known.select("predicted", label).collect()]


@pytest.mark.parametrize(("name", "label", "least"), [("op1_quality", "quality", 0.98), ("op3_toxicity", "toxic", 0.96)])
def test_held_out_accuracy(spark, name, label, least):
    found = held_out_rows(spark, queries.queries()[name](spark, DATA.replace("0.001", "0.1")), label)
    assert sum(p == y for p, y in found) / len(found) >= least


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    texts = {}
    for family in range(6):
        base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(500)) for _ in range(150)]
        for k in range(25):
            own = list(base)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(150)] = "edit" + str(rng.randrange(1000))
            texts[family * 100 + k] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if root[a] < root[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[b] = root[a]
                    changed = True
    for rounds in (1, 2):
        out = near_dedup.near_duplicates(docs, percent=85, rounds=rounds).collect()
        assert {r["doc_id"]: r["component_id"] for r in out} == root
    assert near_dedup.keep_one(docs, 85).count() == len(set(root.values()))


def test_blocks_find_every_link():
    import pandas as pd

    texts = [" ".join(f"w{j if j != 7 * i else 900 + i}" for j in range(200)) for i in range(12)]
    sets = [near_dedup.shingle_set(t) for t in texts]
    sigs = [x.astype(np.uint8).tobytes() for x in near_dedup.signatures(sets)]
    group = pd.DataFrame({"doc_id": range(12), "own": range(12), "apart": True, "part": [i % 2 for i in range(12)], "n_shingles": [len(s) for s in sets], "sig": sigs, "hashes": [s.tobytes() for s in sets]})
    keys = np.array(near_dedup._finer(group["sig"]).tolist())
    found = {tuple(sorted(map(int, p))) for k in np.unique(keys) for block in ((0, 0), (0, 1), (1, 1)) for p in near_dedup._signed_blocks(int(k), block, group, 85)}
    wanted = {(a, b) for a in range(12) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    assert found == {tuple(sorted(p)) for p in wanted} and len(found) == 66


def test_finer_keys_hold_at_the_threshold():
    import pandas as pd

    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, (20_000, near_dedup.COORDINATES), dtype=np.uint8)
    b = np.where(rng.random(a.shape) < near_dedup.PERCENT / 100, a, a + np.uint8(1))
    x, y = (np.array(near_dedup._finer(pd.Series([r.tobytes() for r in s])).tolist()) for s in (a, b))
    # Two in 20,000 are a ten-thousandth; keys of ten coordinates miss about 230.
    assert (~(x == y).any(1)).sum() <= 4


def test_near_duplicates_at_80_with_a_hot_passage(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghijklmnop") + str(rng.randrange(5000))
    hot = [word() for _ in range(80)]
    texts = {}
    for family in range(20):
        base = hot + [word() for _ in range(60)]
        for k in range(4):
            own = list(base)
            for _ in range(k):
                own[80 + rng.randrange(60)] = word()
            texts[family * 10 + k] = " ".join(own)
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if root[a] < root[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[b] = root[a]
                    changed = True
    out = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), percent=80).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == root and len(set(root.values())) >= 20


@pytest.mark.parametrize("spare", [False, True])
def test_lines_of_copies_and_boilerplate(spark, spare):
    page = lambda i: "\n".join([f"own {i} line {j} of a page with words" for j in range(6)])
    copied = "a copied page\nwith two lines\nand a third\nand a fourth of it\nand a fifth"
    docs = [(i, f"{page(i)}\nALL RIGHTS RESERVED", f"s{i}", 7) for i in range(14)]
    docs += [(100 + i, copied, f"s{i}", 7) for i in range(20)]
    docs += [(120, copied + "\nx", "s1", 7), (121, "and a fifth\nwith an own line", "s1", 7)]
    docs += [(200, "short, but not a copy\n ALL RIGHTS RESERVED ", "s1", 7), (201, None, "s2", 7), (None, "words\nALL RIGHTS RESERVED", None, 7), (202, "", "s3", 7), docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n_lines int").withColumns({"_b0_x": F.lit(1), "line_hash": F.lit(2), "row": F.lit(3)})
    out = line_dedup.remove_spread_lines(df, spare_copies=spare)
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["text"], r["n_lines"], r["n_removed"], r["_b0_x"], r["line_hash"], r["row"]) for r in out.collect()), key=repr)
    wanted = [(i, page(i), 7, 1) for i in [*range(14), 0]]
    wanted += [(100 + i, copied, 5, 0) if spare else (100 + i, "", 5, 5) for i in range(20)]
    wanted += [(120, copied + "\nx", 6, 0) if spare else (120, "x", 6, 5), (121, "with an own line", 2, 1)]
    wanted += [(200, "short, but not a copy", 2, 1), (201, None, 0, 0), (-1, "words", 2, 1), (202, "", 1, 0)]
    assert got == sorted(((*w, 1, 2, 3) for w in wanted), key=repr)


def test_decontamination_against_brute_force(spark):
    split = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    norm = lambda t: split.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [(r["item_id"], r["text"]) for r in table(spark, DATA, "benchmark").collect()] + [(900, "Short item"), (901, "ß"), (902, "a a a a a a a a a a a")]
    docs = [(r["doc_id"], r["text"]) for r in table(spark, DATA, "documents").collect()] + [(10_000, "a " * 40 + "the SHORT item"), (10_001, items[0][1]), (10_002, None)]
    found = {}
    for i, text in docs:
        w, hit, met = norm(text), set(), set()
        for k, item in items:
            own = norm(item)
            n = min(10, len(own))
            runs_of = {tuple(own[j : j + n]) for j in range(len(own) - n + 1)} if n else ()
            for j in range(len(w) - n + 1) if n else ():
                if tuple(w[j : j + n]) in runs_of:
                    hit.update(range(j, j + n))
                    met.add(k)
        found[i] = (len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(map(str, met))).encode()).hexdigest(), bool(hit))
    out = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out.collect()} == found


def library_ids(path, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [[*e.ids, end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_ids_are_the_librarys():
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCD  \n.,;'\"!?-0189\u00e9\u00df\u00b5\u00bd\u00d8" + "\u6f22\u00a0\U0001f44d"
    texts = ["".join(rng.choice(letters[: -3 if i % 4 else None]) for _ in range(rng.randrange(200))) for i in range(3000)]
    texts += ["x <|endoftext|> y", "<|startoftext|>It's", "a\x01b\x01", "", " \n ", "don'ts 'SAVE"] + [r"\u0130I\u017f"]
    for path, encoder in ((WORD, tokens.WordEncoder(WORD)), (BYTE[0], tokens.ByteEncoder(*BYTE))):
        assert [x.tolist() for x in encoder.encode(texts)] == [x[:-1] for x in library_ids(path, texts, 0)]


def test_grammar_leaves_no_frequent_pair():
    words = np.random.default_rng(2).zipf(1.3, 60_000) % 400
    rules, symbols = token_store.build_grammar(words)
    assert (token_store.expand(symbols, rules) == words).all()
    _, count = np.unique(symbols[:-1].astype(np.int64) << 16 | symbols[1:], return_counts=True)
    assert count.max() < token_store.LEAST and 2 * len(rules) + len(symbols) < 0.7 * len(words)
    same = np.full(1000, 7)
    rules, symbols = token_store.build_grammar(same)
    assert (token_store.expand(symbols, rules) == same).all() and len(symbols) < 100
    # Exact counts: the first rules are the most frequent pairs.
    pairs, count = np.unique(words[:-1] << 16 | words[1:], return_counts=True)
    first = token_store._frequent((words[:-1] << 16 | words[1:]).astype(np.uint32), 16, 10)
    assert count[np.searchsorted(pairs, first[0])] == count.max()


def test_token_store_round_trip(spark, odd):
    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())
    at, wanted = 0, []
    for (i, _), ids in zip(texts, library_ids(WORD, [t for _, t in texts], 2), strict=True):
        wanted.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(tuple(r) for r in token_store.store_and_read(docs, WORD).collect()) == wanted
    ids = np.random.default_rng(0).integers(0, 50, 20_000)
    rules, symbols = token_store.build_grammar(ids)
    assert len(rules) and len(symbols) < len(ids) and (token_store.expand(symbols, rules) == ids).all()
    block = token_store._block(0, 0, [1], [ids.astype(np.uint16)])
    assert (token_store.decode_range(block, 777, 1234) == ids[777:1234]).all()


def test_byte_ids_of_texts_encoded_together():
    """Runs of blanks, texts without ids and texts that go to the library, side by side, and
    one call of the quick encoder for all that are plain."""
    encoder = tokens.byte_encoder(*BYTE)
    texts = ["", " ", "a  b", "a \n b", "a\n\n", "  ", "\n\n c'll 's", "x\x01y", "\x02", "a\x01", "é ²  ½", "a\tb", "<|endoftext|>", "中  文", "", "end  "]
    rng = random.Random(5)
    texts += ["".join(rng.choices("ab é9²'s.,-  \n\n", k=rng.randrange(30))) for _ in range(500)]
    calls, quick = [], encoder.quick
    encoder.quick = type("Counted", (), {"encode_to_numpy": lambda self, *a, **k: calls.append(1) or quick.encode_to_numpy(*a, **k)})()
    try:
        found = encoder.encode(texts)
    finally:
        encoder.quick = quick
    assert [x.tolist() for x in found] == [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) == 1 and all(x.dtype == np.uint16 for x in found)
    assert encoder.encode([]) == [] and encoder.encode(["\x01"])[0].tolist() == encoder.library.encode("\x01").ids


def test_packing_round_trip(spark):
    docs = table(spark, DATA, "documents").select("doc_id", "text")
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    ids = dict(zip([i for i, _ in texts], library_ids(BYTE[0], [t for _, t in texts], 1), strict=True))
    pieces = packing.pack(docs, *BYTE).collect()
    covered, filled = {}, {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        own = ids[p["doc_id"]]
        assert p["ids_crc32"] == crc(own[p["start"] : p["start"] + p["length"]]) and p["doc_tokens"] == len(own)
        assert p["offset"] == filled.get(p["sequence_id"], 0)
        filled[p["sequence_id"]] = p["offset"] + p["length"]
        covered.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
    assert max(filled.values()) <= 2048
    for i, own in ids.items():
        at = 0
        for start, length in sorted(covered[i]):
            assert start == at
            at += length
        assert at == len(own)


def test_bm25_against_brute_force():
    rng = np.random.default_rng(7)
    ids = [rng.zipf(1.4, rng.integers(1, 60)).clip(0, 300).astype(np.uint16) for _ in range(60)]
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=packing.VOCABULARY)
    idf, mean = np.log1p((60 - df + 0.5) / (df + 0.5)), float(np.mean([len(x) for x in ids]))
    index = packing.Index(ids, idf, mean)
    for seed in range(60):
        wanted = np.zeros(60)
        for d in range(60):
            norm = packing.K1 * (1 - packing.B + packing.B * len(ids[d]) / mean)
            tf = {t: int((ids[d] == t).sum()) for t in np.unique(ids[seed]).tolist()}
            wanted[d] = sum(idf[t] * n * (packing.K1 + 1) / (n + norm) for t, n in tf.items() if n)
        assert np.allclose(index.scores(seed), wanted, rtol=1e-4)
    # A window's first document is followed by its best unused neighbours.
    lengths = np.array([len(x) for x in ids])
    pieces = list(packing.plan_windows(lengths, index, 100))
    first = [d for d, start, _, number, _ in pieces if number == 0]
    ranked = [d for d in np.argsort(-index.scores(first[0]), kind="stable").tolist() if d != first[0]]
    assert first[1:] == ranked[: len(first) - 1]


def test_content_keys():
    ids = [np.array(x, np.uint16) for x in ([5, 6, 7, 1], [1], [9, 5, 6, 7, 1], [1], [5, 6, 7, 1])]
    keys = packing.content_keys(ids)
    assert keys[0] == keys[4] and keys[1] == keys[3] and len(set(keys.tolist())) <= 3


def test_pages(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>x  y<br>z<p>{}</article><div id=comments>c</div><footer>f</footer></body></html>"
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", page.format(f"own {i}")) for i in range(6)] + [(9, None, None)], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in page_template.extract(pages).collect()}
    assert found[9] == "" and all(found[i].endswith(f"own {i}") for i in range(6))
    alone = spark.createDataFrame([(1, "http://one.example/", page.format("own"))], "page_id long, url string, html string")
    assert page_template.extract(alone).collect()[0]["text"] == "A & B\nx y z\nown"


def test_syncmers(spark):
    text = F.lit(" ".join(f"w{i}" for i in range(300)))
    a, b = syncmers.anchors(text), syncmers.anchors(F.concat(F.lit("new words first "), text))
    found = spark.range(1).select(F.size(a).alias("n"), syncmers.matching_positions(a, b).alias("m")).collect()[0]
    assert found["n"] and len(found["m"]) == found["n"] and all(x["b"] == x["a"] + 3 for x in found["m"])


def test_syncmers_of_likely_texts_of_any_kind(spark):
    long = " ".join(f"w{i}" for i in range(300))
    short = " ".join(f"word{i:03}" for i in range(26))  # 207 characters
    pairs = [(long, long + " \u6f22"), (short, short[:-16]), (long, "\u6f22\u5b57 " + long)]
    df = spark.createDataFrame(pairs, "a string, b string")
    found = df.select(syncmers.likeness(syncmers.packed(F.col("a")), syncmers.packed(F.col("b"))).alias("x")).collect()
    assert all(r["x"] > 0.5 for r in found)
    units = df.select(F.size(syncmers.units(F.lit("ab \u6f22\u5b57cd \ud55c"))).alias("n")).collect()[0]["n"]
    assert units == 5


def anchors_by_hand(hashes):
    """(pos, run) of the closed syncmers of a list of hashes of units; runs are tuples of them."""
    k, s = syncmers.K, syncmers.S
    if len(hashes) < k:
        return [(0, tuple(hashes))] if hashes else []
    inner = [hash_of_run[tuple(hashes[i : i + s])] for i in range(len(hashes) - s + 1)]
    return [(i, tuple(hashes[i : i + k])) for i in range(len(hashes) - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])]


hash_of_run: dict = {}


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(6)
    docs = [(r["doc_id"], r["text"]) for r in table(spark, DATA, "documents").orderBy("doc_id").limit(60).collect()]
    moved = " ".join(f"w{i}" for i in [*range(100, 200), *range(100)])
    texts = [" ".join(f"w{i}" for i in range(200)), moved, "\u6f22\u5b57 \ud55c x " * 9, "a b c d e " * 7, "one", None, "", "two words", " ".join(str(rng.randrange(9)) for _ in range(300))]
    texts += ["x" * 199, "word " * 39 + "abcd", "word " * 40 + "abc"]  # about 199 and 203 code points
    docs = sorted({**dict(docs), **{10_000 + i: t for i, t in enumerate(texts)}}.items())
    out = {r["doc_id"]: r for r in syncmers.edited_fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    edited = {}
    for at, (i, text) in enumerate(docs):
        text, after = text or "", docs[(at + 1) % len(docs)][1] or ""
        half = len(text) // 2
        edited[i] = text[: len(text) - half] + after[:half]
        assert out[i]["n_chars"] == len(text) and out[i]["edited_sha256"] == hashlib.sha256(edited[i].encode()).hexdigest()
    every = [t or "" for _, t in docs] + list(edited.values())
    hashed = [r["u"] for r in spark.createDataFrame(list(enumerate(every)), "i int, t string").orderBy("i").select(syncmers.units(F.col("t")).alias("u")).collect()]
    runs = list({tuple(u[i : i + 2]) for u in hashed for i in range(len(u) - 1)})
    frame = spark.createDataFrame(runs, "a long, b long").select("a", "b", F.xxhash64(F.lit(2), "a", "b").alias("h"))
    hash_of_run.update({(r["a"], r["b"]): r["h"] for r in frame.collect()})
    own = {t: anchors_by_hand(u) for t, u in zip(every, hashed, strict=True)}

    def alike(a, b):
        a, b = own[a], own[b]
        if a == b:
            return 1.0
        x, y = {}, {}
        for anchors, into in ((a, x), (b, y)):
            for pos, run in anchors:
                into.setdefault(run, []).append(pos)
        once = sorted((x[r][0], y[r][0]) for r in x.keys() & y.keys() if len(x[r]) == len(y[r]) == 1)
        back = sum(q[1] < p[1] for p, q in zip(once, once[1:]))
        return (len(x.keys() & y.keys()) - back) / len(x.keys() | y.keys()) if a and b else 0.0

    for at, (i, text) in enumerate(docs):
        text, after = text or "", docs[(at + 1) % len(docs)][1] or ""
        assert len(out[i]["fingerprint"]) == 9 * len(own[text]) and len(out[i]["edited_fingerprint"]) == 9 * len(own[edited[i]])
        assert abs(out[i]["near_edited"] - alike(text, edited[i])) < 1e-9 and abs(out[i]["near_next"] - alike(text, after)) < 1e-9
    assert 0.9 < alike(texts[0], moved) < 1


def test_chat_layouts_and_escapes(spark):
    texts = ["<|im_end|>", "<\\|", "a<\\\\|b\n", "", "\\n"]
    turns = spark.createDataFrame([(1, i, "assistant\n<|x|>" if i else "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = chat_format.format_turns(turns).select(chat_format.read_formatted(F.col("formatted")).alias("r")).collect()[0]["r"]
    assert [x["text"] for x in got] == texts and got[1]["role"] == "assistant\n<|x|>"
    records = ['{"prompt": "p", "response": "r"}', '{"messages": [{"role": "human", "content": "q"}, {"role": "gpt", "content": "a"}]}', '{"other": 1}', "broken", None]
    df = spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")
    out = {r["conv_id"]: r for r in chat_format.turns_from_json(df).collect()}
    assert [x["text"] for x in out[0]["turns"]] == ["p", "r"] and [x["role"] for x in out[1]["turns"]] == ["user", "assistant"]
    assert all(out[i]["layout"] is None for i in (2, 3, 4))


def test_chat_loss_is_cut_by_the_mask(spark):
    said = [("user", "q"), ("assistant", "<\\"), ("assistant", "|\u6f22\U0001f44d<|im_end|>"), (None, None), ("assistant", ""), ("assistant", "<|x|>" * 3), ("assistant", "<|x|>" * 3)]
    turns = [(1, i - 1 if i else None, r, t, "clash", 5) for i, (r, t) in enumerate(said)] + [(None, 0, "assistant", "of no id", "", 0)]
    df = spark.createDataFrame([*turns, turns[2], (2, 0, "assistant", "long <| " * 50_000, "", 1)], "conv_id long, turn long, role string, text string, formatted string, n int")
    formatted = chat_format.format_turns(chat_format.canonical_turns(df))
    out = {r["conv_id"]: r for r in chat_format.digests(formatted).collect()}
    assert out[1]["n_turns"] == 8
    order = sorted([*turns[:7], turns[2]], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    wanted = "".join(r[3] for r in order if r[2] == "assistant")
    assert out[1]["loss_sha256"] == hashlib.sha256(wanted.encode()).hexdigest() and out[1]["loss_chars"] == len(wanted)
    whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in order)
    assert out[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert out[2]["loss_chars"] == 400_000 and out[None]["n_turns"] == 1
    # Without its spans a string has no loss.
    none = formatted.withColumn("loss_spans", F.filter("loss_spans", lambda x: F.lit(False)))
    assert {r["loss_chars"] for r in chat_format.digests(none).collect()} == {0}


def test_layouts_by_all_their_paths(spark):
    choose = lambda ddl: chat_format.choose_layout(spark.createDataFrame([], ddl).schema).name
    assert choose("conv_id long, turn long, role string, text string, band long, n int") == "rows"
    assert choose("conv_id long, prompt string, response string") == "prompt_response"
    both = "conv_id long, prompt string, response string, messages array<struct<role:string,content:string>>, extra struct<a:int>"
    assert choose(both) == "messages"
    assert choose("instruction string, input string, output string") == "instruction_input"
    with pytest.raises(ValueError, match="no chat layout"):
        choose("a int, text string")
    records = spark.createDataFrame([(1, '{"prompt": "p", "response": "r", "messages": []}'), (2, '{"instruction": "i", "output": null}')], "conv_id long, record string")
    out = {r["conv_id"]: (r["layout"], r["turns"]) for r in chat_format.turns_from_json(records).collect()}
    assert out[1] == (None, None) and out[2][0] == "instruction" and [t["text"] for t in out[2][1]] == ["i"]


def test_restoring_disguised_words(spark):
    docs = spark.createDataFrame([("you are an idiot and a stupid idiot " * 50,)], "text string")
    r = toxicity.Restorer(toxicity.character_model(docs))
    assert r.decode("1d10t") == "idiot" and r.decode("stuuuupid") == "stupid" and "idiot" in r.restore("i d i o t")
    for text in ("1 d 1 0 t", "y o u  a r e  a n  i d i o t", "i.d.1.0.t", "so $tup1d", "suuuch an !d!ot", "i-d-i-o-t!", "s t u p 1 d"):
        assert {"idiot", "stupid"} & set(re.findall("[a-z]+", r.restore(text))), r.restore(text)
    for text in ("stuuupid it", "stuuupid"):  # short or long, by the same rule
        assert "stupid" in r.restore(text).split()
    assert r.restore("\u00e9\u00e9\u00e9 2024 100% a b") and r.restore("") == ""


def disguised(text, rng):
    """The text with its longer words written in signs, drawn out or set apart."""
    signs = str.maketrans({"i": "1", "o": "0", "e": "3", "a": "@", "s": "$", "t": "7"})

    def one(word):
        kind = rng.randrange(4)
        if kind == 0:
            return word.translate(signs)
        if kind == 1:
            at = rng.randrange(1, len(word) - 1)
            return word[:at] + word[at] * 3 + word[at:]
        return rng.choice((" ", ".", "-")).join(word if kind == 2 else word.translate(signs))

    return re.sub(r"[a-z]{4,}", lambda m: one(m[0]), text)


def test_decoding_finds_disguised_toxic_documents(spark):
    root = DATA.replace("0.001", "0.1")
    docs, labels = table(spark, root, "documents").select("doc_id", "text"), table(spark, root, "labels")
    model = toxicity.train(docs, labels)
    known = docs.join(labels.where("toxic IS NOT NULL"), "doc_id").where(held_out(F.col("doc_id"))).select("doc_id", "text", "toxic").collect()
    rng = random.Random(9)
    marks = [m.strip() for m in model["marks"] if m.isascii() and len(m.strip()) > 3]
    only = re.compile("|".join(rf"(?<![^\W\d_]){m}[a-z]*" for m in sorted(marks)))
    hidden = [(r["doc_id"], only.sub(lambda m: disguised(m[0], rng), (r["text"] or "").lower()), r["toxic"]) for r in known]
    frame = spark.createDataFrame(hidden, "doc_id long, text string, toxic int")
    found = {}
    for decode in (True, False):
        out = toxicity.score_documents(frame, model, decode).collect()
        caught = [r["toxicity_score"] >= toxicity.CUT for r in out if r["toxic"] == 1]
        wrong = [r["toxicity_score"] >= toxicity.CUT for r in out if r["toxic"] == 0]
        found[decode] = (sum(caught) / len(caught), sum(wrong) / len(wrong))
    print("recall, false alarms with and without decoding:", found)
    assert found[True][0] >= 0.8 and found[True][0] >= found[False][0] + 0.3 and found[True][1] <= 0.03


def test_pipeline(spark):
    docs = table(spark, DATA, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out
    packed = corpus_pipeline.run(spark, DATA)
    assert packed.select("doc_id").distinct().count() == docs.count()


CLASHING = ("quality_score", "toxicity_score", "n_shingles", "component_id", "kept", "digest", "bands", "sig", "n_words", "n_hit", "item_ids", "contaminated", "fingerprint", "n_lines", "n_removed", "hashes", "row", "line_hash", "ids", "n", "key", "start", "shard")


def test_result_names_in_the_input_change_nothing(spark, odd, labels):
    clashing = odd.withColumns({c: F.lit("clash") for c in CLASHING})
    plain = dict(runs(spark, odd, labels))
    for name, out in runs(spark, clashing, labels):
        shared = [c for c in plain[name].columns if c in out.columns]
        assert shared == plain[name].columns, name
        a, b = (sorted(map(repr, x.select(*shared).collect())) for x in (plain[name], out))
        assert a == b, name
    a, b = (sorted(map(repr, packing.pack(x, *BYTE).collect())) for x in (odd, clashing))
    assert a == b


def test_pipeline_stages_on_odd_rows(spark, odd, labels, tmp_path):
    sf = str(tmp_path)
    items = [("1", "three four five six seven eight nine ten eleven twelve"), (None, None), ("3", "")]
    odd.write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{sf}/benchmark.parquet")
    model = quality.train(odd, labels)
    good = [r["doc_id"] for r in quality.score_documents(odd, model).collect() if r["quality_score"] >= quality.CUT]
    every = [r["doc_id"] for r in odd.collect()]
    # Rows that repeat an id are one document to near dedup; those of no id stay.
    wanted = {
        "quality": good,
        "line_dedup": every,
        "near_dedup": [i for i in every if i not in (5, 6)],
        "decontaminate": [i for i in every if i not in (4, 5, 6, 9)],
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns, name
        rows_out = out.collect()
        assert sorted(map(repr, (r["doc_id"] for r in rows_out))) == sorted(map(repr, wanted[name])), name
        # What stays is as it was.
        assert {repr(r) for r in rows_out} <= {repr(r) for r in odd.collect()}, name
        assert stage(spark, odd.limit(0), sf).count() == 0, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, odd, sf).collect()
    assert sorted(map(repr, {r["doc_id"] for r in pieces})) == sorted(map(repr, set(every)))
    assert sum(r["length"] for r in pieces) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)
    assert corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), sf).count() == 0


def test_odd_pages(spark):
    page = "<html><body><nav><a href='/'>Home</a></nav><article><p>The {} text\n of  the page &amp; more.</p><figure><figcaption>A {} caption</figcaption></figure></article><footer>All rights</footer></body></html>"
    same = page.format("same", "plain")
    htmls = [None, "", "<p>", same, same, page.format("long " * 40_000, "last"), "<div>x" * 3_000]
    pages = [(i, "http://h.example/" + str(i) if i != 1 else None, h, "clash", 7) for i, h in enumerate(htmls)]
    df = spark.createDataFrame([*pages, pages[4]], "page_id long, url string, html string, text string, n_chars int")
    out = page_template.extract(df)
    found = sorted((r["page_id"], r["text"], r["n_chars"]) for r in out.collect())
    assert [r[0] for r in found] == [0, 1, 2, 3, 4, 4, 5, 6]
    assert all(n == len(t) for _, t, n in found)
    said = dict((i, t) for i, t, _ in found)
    assert said[0] == said[1] == said[2] == ""
    assert said[3] == said[4] == "The same text of the page & more.\nA plain caption"
    assert said[5] == "The " + " ".join(["long"] * 40_000) + " text of the page & more.\nA last caption"
    assert said[6] == "\n".join(["x"] * 3_000)
    assert page_template.extract(df.limit(0)).count() == 0


def test_templates_against_brute_force(spark):
    """Slots by hand: three classes of tokens, one of them repeated, and a text between every two."""
    a, b, c, x, y, z = 11, 12, 13, 21, 22, 23
    tokens = [a, 1, b, x, 2, y, 3, z, x, 4, y, z, 5, c, 6]
    slots = page_template.nested(tokens, [[a, b, c], [x, y, z]])
    where = {t: s for t, s in zip(tokens, slots, strict=True) if t < 10}
    assert where[6] == 0 and len({where[1], where[2], where[3], where[5]}) == 4
    assert where[2] == where[4]  # the same place in each repetition
    # A class out of order has no slots; of two that cross the larger stays.
    assert page_template.nested([b, 1, a, c], [[a, b, c]]) == [0, 0, 0, 0]
    crossed = page_template.nested([a, x, 1, b, y, c, z], [[a, b, c, 99][:3], [x, y, z, 98][:3]])
    assert crossed[2] and len({s for s in crossed if s}) == 2
    deep = "<div>x" * 20_000
    import time

    began = time.time()
    assert len(page_template.pieces_of(deep, [])) == 20_000 and time.time() - began < 5


def test_the_template_does_the_extraction(spark):
    frame = "<html><body><div class=q1><a href=/{0}>Menu {0}</a> <a>more</a></div><div class=q2><h1>Title {0}</h1><p>own text {0} of this page, long enough<figure><figcaption>caption {0}</figcaption></figure><p>and <b>more {0}</b> of it</div><div class=q3>All pages say this</div></body></html>"
    rows = [(i, f"http://h.example/{i}", frame.format(f"k{i}")) for i in range(8)]
    rows += [rows[0], (90, "http://h.example/x", frame.format("k0")), (91, "http://h.example/y", None), (92, None, "<p>alone"), (93, "http://one.example/", "<nav>menu</nav><p>alone")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, host string, slots int")
    found = sorted((r["page_id"], r["text"], r["n_chars"]) for r in page_template.extract(pages, min_pages=4).collect())
    said = lambda k: f"Title {k}\nown text {k} of this page, long enough\ncaption {k}\nand more {k} of it"
    wanted = [(i, said(f"k{i}")) for i in range(8)] + [(0, said("k0")), (90, said("k0")), (91, ""), (92, "alone"), (93, "alone")]
    assert found == sorted((i, t, len(t)) for i, t in wanted)
    # Without a template neither the menu nor the fixed text is known: the names say nothing.
    bare = {r["page_id"]: r["text"] for r in page_template.extract(pages, min_pages=10**9).collect()}
    assert "Menu k1" in bare[1] and "All pages say this" in bare[1]
    assert {r["text"] for r in page_template.extract(pages, names=False, min_pages=4).where("page_id < 8").collect()} == {said(f"k{i}") for i in range(8)}
