"""Toxicity by noisy-channel deobfuscation.

A character trigram model counts the letters of all documents. Spans that may be
disguised (signs or digits for letters, letters drawn out, letters set apart, or
all of these) are lattices of what each character may stand for: a sign for its
letters or for nothing, a drawn-out letter for one or two, a blank between single
characters for nothing or for the end of a word. Viterbi decoding picks the reading
with the best product of channel and language model. The restored text is then
scored: words and word beginnings that mark labelled toxic documents are chosen
greedily, each for documents that no earlier one explains, and a logistic curve
over their hits gives the score. Words cut into longer parts are not joined.

Fitted on a bounded sample: of each label the ``SAMPLE`` rows with the smallest
hashes of their ids; half of them choose the marks, the other half the curve. The
character model covers every document. Scoring reads every row and whole texts.

Cases: a null or empty text has no hits; repeated rows score alike; null labels
and labels without a document teach nothing; an empty table gives an empty table;
without both labels every score is 0; a column ``toxicity_score`` is replaced,
other columns pass through unread.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterspark.llm.common import held_out

SAMPLE, SEED = 4000, 11
#: The score from which on a document counts as toxic.
CUT = 0.3
#: Marks: least documents (and of toxic ones a hundredth) that a mark must add, how
#: many times likelier it must be in toxic documents, from which ratio on a single
#: hit is strong evidence, and how many marks explain a document.
LEAST, TIMES, STRONG, DEMAND = 4, 4, 15, 2
PREFIXES = (4, 5, 6, 7)

# What a sign or digit may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "(": "c", "*": "aeiou"}
#: Log probabilities of the channel: a sign for its letter, a sign for nothing, a drawn-out
#: letter, and a word's end at one separator or at several.
P_SIGN, P_DROP, P_STRETCH, P_END, P_WIDE_END = -0.5, -14.0, -0.2, -4.0, -0.5
#: What may stand between letters that are set apart.
SEPARATORS = " .-_*"
#: Codes of the character model: 0 no letter, 1-26 a-z, 27-58 the letters from U+00E0, 63 any other letter.
CODES = 64

_WORD = re.compile(r"[^\W\d_]+")
_SIGNED = re.compile(r"[^\s]*[0-9@$!|+€(*][^\s]*")
_STRETCHED = re.compile(r"[^\s]*?([^\W\d_])\1\1[^\s]*")
_ELEMENT = r"(?:[^\W\d_]|[013456789@$!|+€(])"
_SPACED = re.compile(rf"(?<![\w@$!|+€(])(?:{_ELEMENT}[{re.escape(SEPARATORS)}]{{1,2}}){{2,}}{_ELEMENT}(?!!?[\w@$|+€(])")
_TAIL = re.compile(r"(?:([^\w\s])\1\1+|!+|[.,;:?)\"']+)+$")
#: By code point: letters, and signs that may stand for one. Beyond these planes nothing is drawn out or set apart.
_LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])
_SIGN = np.zeros(1 << 16, bool)
_SIGN[[ord(c) for c in LEET]] = True
_SIGN_INSIDE = _SIGN.copy()
_SIGN_INSIDE[ord("*")] = False


def _codes(text: str) -> np.ndarray:
    """Codes of a lower-cased text, with 0 before and after."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.zeros(len(c) + 4, np.int64)
    inner = out[2:-2]
    small = (c >= 97) & (c <= 122)
    inner[small] = c[small] - 96
    latin = (c >= 0xE0) & (c < 0x100)
    inner[latin] = c[latin] - 0xE0 + 27
    inner[c >= 0x100] = 63
    return out


def _code(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else ord(ch) - 0xE0 + 27 if 0xE0 <= ord(ch) < 0x100 else 63 if ord(ch) >= 0x100 else 0


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(CODES**3, np.int64)
    held: list[np.ndarray] = []

    def add() -> None:
        c = np.concatenate(held)
        total[:] += np.bincount((c[:-2] * CODES + c[1:-1]) * CODES + c[2:], minlength=CODES**3)
        held.clear()

    for b in batches:
        for text in b["text"]:
            if text:
                held.append(_codes(text.lower()))
                if sum(map(len, held)) > 2_000_000 or len(held) > 500:
                    add()
    if held:
        add()
    at = np.flatnonzero(total)
    yield pd.DataFrame({"gram": at, "n": total[at]})


def character_model(docs: DataFrame) -> np.ndarray:
    """Log P(c | a, b), smoothed, from the texts of all documents; CODES**3 values."""
    counts = docs.select("text").mapInPandas(_count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    n = np.zeros(CODES**3)
    for r in counts.collect():  # CODES**3 rows at most
        n[r["gram"]] = r["n"]
    n = n.reshape(CODES, CODES, CODES)
    uni = n.sum((0, 1)) + 1.0
    uni /= uni.sum()
    pair = n.sum(0)
    p2 = (pair + 20 * uni) / (pair.sum(1, keepdims=True) + 20)
    p3 = (n + 20 * p2[None]) / (n.sum(2, keepdims=True) + 20)
    return np.log(p3).astype(np.float32)


class Restorer:
    """Viterbi decoding of disguised tokens under the character model."""

    KEPT = 100_000

    def __init__(self, logp: np.ndarray):
        self.logp = logp.tolist()
        self.known: dict[str, str] = {}

    def decode(self, token: str) -> str:
        if (out := self.known.get(token)) is None:
            if len(self.known) >= self.KEPT:
                self.known.clear()
            out = self.known[token] = self._decode(token)
        return out

    def _decode(self, token: str) -> str:
        best = {(0, 0): (0.0, "")}  # by the last two codes: log probability, reading
        apart = len(token) > 1 and _SPACED.fullmatch(token) is not None
        i = 0
        while i < len(token):
            ch, run = token[i], 1
            while i + run < len(token) and token[i + run] == ch:
                run += 1
            if apart and ch in SEPARATORS:
                while i + run < len(token) and token[i + run] in SEPARATORS:
                    run += 1
                ways = [("", 0.0), (" ", P_WIDE_END if run > 1 else P_END)]
            elif ch in LEET:
                ways = [(x * k, P_SIGN * run) for x in LEET[ch] for k in ((run,) if run < 3 else (1, 2))] + [("", P_DROP)]
            elif ch.isalpha():
                ways = [(ch * run, 0.0)] if run < 3 else [(ch, P_STRETCH), (ch * 2, P_STRETCH)]
            else:
                ways = [("", P_SIGN)]
            i += run
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (p, said) in best.items():
                for letters, cost in ways:
                    x, y, q = a, b, p + cost
                    for c in letters:
                        k = _code(c)
                        q += self.logp[x][y][k]
                        x, y = y, k
                    if (x, y) not in after or after[x, y][0] < q:
                        after[x, y] = (q, said + letters)
            best = after
        return max((p + self.logp[a][b][0], said) for (a, b), (p, said) in best.items())[1]

    def _signed(self, m: re.Match) -> str:
        token = m[0]
        core = _TAIL.sub("", token)
        letters = sum(map(str.isalpha, core))
        if letters < 1 or letters == len(core) or len(core) < 3 or not any(c in LEET for c in core):
            return token
        # Both readings count: a token with signs may mean just what it says.
        return f"{token} {self.decode(core)}"

    def _apart(self, m: re.Match) -> str:
        return f"{m[0]} {self.decode(m[0])} " if sum(map(str.isalpha, m[0])) > 1 else m[0]

    def restore(self, text: str) -> str:
        """The lower-cased text with the readings of its disguised spans."""
        text = text.lower()
        c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        c = np.minimum(c, 0xFFFF)
        letter = _LETTER[c]
        # Cheap tests of what the patterns need, on every text alike.
        beside = np.zeros(len(c) + 2, bool)
        beside[1:-1] = letter | (_SIGN_INSIDE[c] & (c != ord("!")))
        alone = np.zeros(len(c) + 8, bool)
        alone[: len(c)] = (letter | _SIGN_INSIDE[c]) & ~beside[:-2] & ~beside[2:]
        follows = alone[:-3] & (alone[2:-1] | alone[3:])
        if (follows[:-3] & (follows[2:-1] | follows[3:])).any():
            text = _SPACED.sub(self._apart, text)
        if (letter[2:] & (c[2:] == c[1:-1]) & (c[2:] == c[:-2])).any():
            text = _STRETCHED.sub(lambda m: f"{m[0]} {self.decode(_TAIL.sub('', m[0]))}", text)
        if _SIGN[c].any():
            text = _SIGNED.sub(self._signed, text)
        return text


def marks_of(restored: str) -> set[str]:
    """Words (ending in a space) and word beginnings of a restored text."""
    words = set(_WORD.findall(restored))
    found = {f"{w} " for w in words}
    for k in PREFIXES:
        found.update(w[:k] for w in words if len(w) > k)
    return found


def hits_of(restored: str, marks: dict[str, bool]) -> tuple[int, int, int]:
    """Hits of strong marks and of weak ones, and all words, of a restored text."""
    said = _WORD.findall(restored)
    hits = [0, 0]
    for w, n in Counter(said).items():
        # The longest mark of a word speaks for it.
        strong = marks.get(f"{w} ")
        for k in reversed(PREFIXES):
            if strong is None and len(w) > k:
                strong = marks.get(w[:k])
        if strong is not None:
            hits[not strong] += n
    return hits[0], hits[1], len(said)


WIDTH = 7


def _vector(strong: int, weak: int, n: int) -> list[float]:
    per = 100 / max(n, 1)
    return [1.0, float(strong > 0), np.log1p(strong), float(weak > 0), np.log1p(weak), np.log1p(weak * per), np.log1p(n) / 10]


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + l2 * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + (l2 + 1e-6) * np.eye(len(w)), gradient)
    return w


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The character model of all documents, and marks and curve of a bounded sample."""
    spark = docs.sparkSession
    logp = character_model(docs)
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    order = F.xxhash64("doc_id", F.lit(SEED))
    share = known.agg(F.avg("label")).collect()[0][0] or 0.0
    some = [known.where(F.col("label") == k).orderBy(order, "doc_id").limit(SAMPLE) for k in (0, 1)]
    some = some[0].unionByName(some[1])  # 2 * SAMPLE rows at most
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").dropDuplicates(["text", "label"])
    rows = rows.select("label", (F.xxhash64("doc_id", F.lit(SEED + 1)) % 2 == 0).alias("fold"), "text")
    sent = spark.sparkContext.broadcast(logp)

    def restored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Restorer(sent.value)
        for b in batches:
            yield b.assign(text=[r.restore(t or "") for t in b["text"]])

    rows = rows.mapInPandas(restored, rows.schema).cache()  # 2 * SAMPLE rows at most
    sizes = {(r["fold"], r["label"]): r["n"] for r in rows.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get((True, 1), 0), sizes.get((True, 0), 0)
    if not toxic or not clean:
        rows.unpersist()
        return {"logp": logp, "marks": {}, "w": None}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for label, text in zip(b["label"], b["text"], strict=True):
                seen[label].update(marks_of(text))
        marks = list(seen[0].keys() | seen[1].keys())
        yield pd.DataFrame({"mark": marks, "t": [seen[1][m] for m in marks], "c": [seen[0][m] for m in marks]}).astype({"t": "int64", "c": "int64"})

    counted = rows.where("fold").select("label", "text").mapInPandas(count, "mark string, t long, c long").groupBy("mark").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    # Marks of at least a hundredth of the toxic sample: at most a hundred times as many
    # as one of its documents has on average.
    telling = counted.where((F.col("t") >= max(LEAST, toxic / 100)) & (F.col("t") * clean > TIMES * (F.col("c") + 1) * toxic))
    candidates = {r["mark"]: (r["t"] / toxic, (r["c"] + 0.5) / clean) for r in telling.collect()}

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"marks": [sorted(m for m in marks_of(t) if m in candidates) for t in b["text"]]})

    held_rows = rows.where("fold AND label = 1").select("text").mapInPandas(held, "marks array<string>").collect()
    left = [[set(m), DEMAND] for m in sorted({tuple(r["marks"]) for r in held_rows})]
    marks: dict[str, bool] = {}
    while True:  # greedy cover: a document that DEMAND chosen marks explain teaches no further mark
        tally = Counter(m for s, _ in left for m in s)
        best = max(((n - 3 * candidates[m][1] * toxic, n, len(m), m) for m, n in tally.items() if n >= max(LEAST, toxic / 100)), default=(0, 0, 0, ""))
        if best[0] <= 0:
            break
        t, c = candidates[best[3]]
        marks[best[3]] = t > STRONG * c
        # Beginnings of the same words, longer or shorter, say nothing more.
        stem = best[3].rstrip()
        left = [[{m for m in s if not m.startswith(stem) and not stem.startswith(m.rstrip())} if best[3] in s else s, d - (best[3] in s)] for s, d in left if d > (best[3] in s)]

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"label": b["label"], "x": [_vector(*hits_of(t, marks)) for t in b["text"]]})

    fold = rows.where("NOT fold").select("label", "text").mapInPandas(vectors, "label int, x array<double>").collect()
    rows.unpersist()
    x, y = np.array([r["x"] for r in fold]).reshape(-1, WIDTH), np.array([r["label"] for r in fold], float)
    if not len(y) or y.min() == y.max():
        return {"logp": logp, "marks": marks, "w": None}
    w = _logistic(x, y)
    # The sample holds the labels more evenly than the table does.
    w[0] += np.log(max(share, 1e-6) / max(1 - share, 1e-6)) - np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))
    return {"logp": logp, "marks": marks, "w": w}


def score_column(docs: DataFrame, model: dict, decode: bool = True):
    """A column function from a text to its score; other columns stay in the JVM. Without
    ``decode`` texts are scored as they stand."""
    sent = docs.sparkSession.sparkContext.broadcast(model["logp"])  # CODES**3 values
    marks, w = model["marks"], model["w"]

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        r = Restorer(sent.value)
        for texts in batches:
            x = np.array([_vector(*hits_of(r.restore(t or "") if decode else (t or "").lower(), marks)) for t in texts]).reshape(-1, WIDTH)
            yield pd.Series(np.zeros(len(x)) if w is None else 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))

    return scored


def score_documents(docs: DataFrame, model: dict, decode: bool = True) -> DataFrame:
    """``docs`` with a column ``toxicity_score`` from 0 to 1, which replaces one of that name."""
    return docs.withColumn("toxicity_score", score_column(docs, model, decode)("text"))
