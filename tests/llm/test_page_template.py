"""Main text of pages: the template decides, names break ties; classes against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from rosterspark.llm import page_template
from rosterspark.llm.common import table

PAGES = "page_id long, url string, html string"


def text_of(df, **options):
    return {r["page_id"]: r["text"] for r in page_template.extract(df, **options).collect()}


def test_renamed_classes_change_little(spark):
    pages = table(spark, DATA, "pages")

    def renamed(html):  # tasks cannot import this module
        return html and re.sub(r'\b(class|id)=("[^"]*"|[^">\s]+)', lambda m: f'{m[1]}="q{hashlib.md5(m[2].encode()).hexdigest()[:8]}"', html)

    other = pages.withColumn("html", F.udf(renamed)("html"))
    full, without, alone = text_of(pages), text_of(other), text_of(pages, names=False)
    assert sum(full[k] == without[k] for k in full) >= 0.9 * len(full)
    assert sum(full[k] == alone[k] for k in full) >= 0.9 * len(full)


NAMES = ("content has-sidebar", "post comments-open", "entry with-header", "article-body no-ads", "layout--with-nav", "modal-free", "wide", "sidebar")


@pytest.mark.parametrize("min_pages", [4, 10**9])
def test_wrappers_lose_nothing(spark, min_pages):
    words = " ".join(f"word{i} of the article" for i in range(40))
    page = "<html><body><nav><a href=/>Home</a></nav><div class='{0}'><h2>Part {1}</h2><p>{2} {1}</p><p>second {1} {2}</p></div><div class='{3}'>Copyright {1}</div></body></html>"
    rows = [(100 * k + i, f"http://h{k}.example/{i}", page.format(name, i, words, "x" if k % 2 else "footer")) for k, name in enumerate(NAMES) for i in range(8)]
    found = text_of(spark.createDataFrame(rows, PAGES), min_pages=min_pages)
    for k, name in enumerate(NAMES):
        for i in range(8):
            lines = found[100 * k + i].split("\n")
            assert lines[-2:] == [f"{words} {i}", f"second {i} {words}"], name
            assert name == "sidebar" or lines[0] == f"Part {i}"


def test_what_stands_beside_the_article(spark):
    words = " ".join(f"word{i} of the article" for i in range(40))
    page = (
        "<html><body><div class=ka><a href=/{0}>Link {0}</a></div><div class=kb>Buy {0} now</div><h1>Title {0}</h1><div class=kc><p>Intro {0}</p><section><p>{1} {0}</p></section><p>Outro {0}</p></div>"
        "<div class=kd><p>Second column {0} {1}</p></div><div class=comments><p>I liked {0} {1}</p></div><div class=ke>All rights {0}</div></body></html>"
    )
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", page.format(i, words)) for i in range(9)], PAGES)
    for min_pages in (4, 10**9):
        said = text_of(pages, min_pages=min_pages)[5].split("\n")
        assert "Title 5" in said and f"{words} 5" in said and f"Second column 5 {words}" in said
        assert not {"Link 5", "Buy 5 now", "All rights 5", f"I liked 5 {words}"} & set(said)


def test_classes_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(40):
        items = "".join(f"<li class=i><b>{rng.randrange(9)}</b></li>" for _ in range(rng.randrange(4)))
        extra = "<div class=e><span class=s>Extra</span></div>" if i % 2 else ""
        rows.append((i, f"http://h{i % 3}.example/", f"<div class=a><ul class=l>{items}</ul><p class=b>Fixed text</p>{extra}<i>{rng.random()}</i></div>"))
    df = spark.createDataFrame(rows, PAGES).withColumn("host", page_template.host_of(F.col("url")))
    found = {r["host"]: r["classes"] for r in page_template.host_classes(df, min_pages=4, support=0.3, min_class=3).collect()}
    for host in {f"h{k}.example" for k in range(3)}:
        pages = [[t for t, *_ in page_template.tokens_of(h) if t] for _, u, h in rows if host in u]
        counts, places = [Counter(p) for p in pages], defaultdict(list)
        for p in pages:
            for t in set(p):
                places[t].append(p.index(t))
        vectors = defaultdict(list)
        for t, own in places.items():
            if len(own) >= max(4, 0.3 * len(pages)):
                vectors[tuple(c[t] for c in counts)].append(t)
        want = [[page_template._signed(t) for t in sorted(ts, key=lambda t: (sum(places[t]) / len(places[t]), page_template._signed(t)))] for ts in vectors.values() if len(ts) >= 3]
        assert sorted(want) == sorted(found[host])


def test_slots_against_brute_force(spark):
    """Sums of each slot and the choice among them, recomputed from the pieces."""
    rng = random.Random(4)
    kinds = [(f"<div class=c{'abcd'[k]}><p>{{}}</p></div>", n) for k, n in enumerate((40, 3, 12, 1))]
    rows = [(i, f"http://h{i % 2}.example/", "<body>" + "".join(f.format(" ".join(f"w{rng.randrange(999)}" for _ in range(n))) for f, n in kinds) + "</body>") for i in range(30)]
    df = spark.createDataFrame(rows, PAGES).withColumn("host", page_template.host_of(F.col("url")))
    pieces = page_template.page_pieces(df, page_template.host_classes(df))
    found = {r["host"]: r for r in page_template.article_slots(pieces).collect()}
    for host in ("h0.example", "h1.example"):
        free, homes = Counter(), Counter()
        for r in pieces.where(F.col("host") == host).collect():
            own = Counter()
            for b in r["blocks"]:
                for p in b["pieces"]:
                    free[p["slot"]] += len(p["text"])
                    own[r["boxes"][b["box"]]["home"]] += len(p["text"])
            assert r["page_home"][-1] == max(own, key=own.get) and r["page_free"] == max(own.values())
            homes[tuple(r["page_home"])] += r["page_free"]
        main = max(free, key=free.get)
        assert found[host]["main"] == main and tuple(found[host]["home"]) == homes.most_common(1)[0][0]
        assert set(found[host]["large"]) == {s for s in free if free[s] >= 0.25 * free[main]} and set(found[host]["slots"]) == set(free)
