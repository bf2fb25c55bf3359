"""Scoring, language, quality, BPE, personal data and HTML against plain-Python versions."""

import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm_cases import EDGE, LONG, edge, empty, quality, rest, words

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def documents(sf=SF):
    return duckdb.sql(f"select doc_id, text, lang from '{sf}/documents.parquet'").fetchall()


def by_text(rows, *cols):
    return sorted([tuple(r[c] for c in cols) for r in rows], key=repr)


# context-tree weighting

def kt(a, b):
    return math.lgamma(a + .5) + math.lgamma(b + .5) - math.log(math.pi) - math.lgamma(a + b + 1)


class Tree:
    """Context trees of every bit node, straight from the definition."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, Counter()
        for t in texts:
            s = bytes([255]) * depth + t + b"\xff"
            for i in range(depth, len(s)):
                for j in range(8):
                    so_far, bit = (1 << j) | (s[i] >> (8 - j)), s[i] >> (7 - j) & 1
                    for d in range(depth + 1):
                        self.n[s[i - d:i], so_far, bit] += 1
        self.kids = {}
        for ctx, so_far, _ in self.n:
            if ctx:
                self.kids.setdefault((ctx[1:], so_far), set()).add(ctx)
        self.memo = {}

    def counts(self, ctx, so_far):
        return self.n[ctx, so_far, 0], self.n[ctx, so_far, 1]

    def pw(self, ctx, so_far):
        if (ctx, so_far) not in self.memo:
            pe = kt(*self.counts(ctx, so_far))
            if len(ctx) < self.depth:
                below = sum(self.pw(c, so_far) for c in self.kids.get((ctx, so_far), ()))
                pe = math.log(.5 * math.exp(pe) + .5 * math.exp(below))
            self.memo[ctx, so_far] = pe
        return self.memo[ctx, so_far]

    def one(self, s, i, so_far, d=0):
        ctx = s[i - d:i]
        a, b = self.counts(ctx, so_far)
        p = (b + .5) / (a + b + 1)
        if d == self.depth:
            return p
        stop = .5 * math.exp(kt(a, b) - self.pw(ctx, so_far)) if a + b else .5
        return stop * p + (1 - stop) * self.one(s, i, so_far, d + 1)

    def score(self, t):
        s, out = bytes([255]) * self.depth + t + b"\xff", 0.0
        for i in range(self.depth, len(s)):
            for j in range(8):
                p = self.one(s, i, (1 << j) | (s[i] >> (8 - j)))
                out += math.log10(p if s[i] >> (7 - j) & 1 else 1 - p)
        return out


@pytest.mark.parametrize("top", [1 << 18, 8])
def test_ctw_equals_the_definition(spark, top):
    from sensortracks.llm.ctw import score_documents

    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["ab", "Ba", "cab", "dé"]) for _ in range(rng.randint(0, 5)))) for i in range(30)]
    docs += [(30, None), (30, "new word"), (None, "ab"), (33, "  ab\tba ")]
    got = score_documents(spark.createDataFrame(docs, "doc_id long, text string"), depth=2,
                          top_words=top, top_grams=top).collect()
    train = [t for d, t in docs if rest(d, 7) != 2]
    tree = Tree([" ".join(words(t)).encode() for t in train], 2)
    c = Counter(w for t in train for w in [*words(t), ""])
    n, v = sum(c.values()), len(c)
    want = []
    for d, t in docs:
        w = [*words(t), ""]
        want.append((d, rest(d, 7) == 2, len(w), sum(c[x] > 0 for x in w), n,
                     round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 9),
                     round(tree.score(" ".join(words(t)).encode()), 7)))
    have = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9),
             round(r["score"], 7)) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_ctw_is_a_distribution_and_beats_unigrams(spark):
    from sensortracks.llm.ctw import score_documents

    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = score_documents(df).toPandas()
    assert (out["score"] < 0).all() and out["bits_per_byte"].mean() < 2.5
    for _, part in out.groupby("held_out"):
        assert part["score"].sum() > part["base_score"].sum()


def test_ctw_edges(spark):
    from sensortracks.llm.ctw import score_documents

    assert score_documents(empty(spark)).count() == 0
    rows = score_documents(edge(spark)).collect()
    assert len(rows) == len(EDGE) and all(r["score"] < 0 and math.isfinite(r["base_score"]) for r in rows)


# language

def plain_grams(text):
    """N-gram counts of a text, word by word."""
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        p = f" {word} "
        out.update(word)
        out.update(p[i:i + 2] for i in range(len(p) - 1))
        out.update(p[i:i + 3] for i in range(len(p) - 2))
    return out


def ranked(counts, size):
    code = lambda g: [ord(c) for c in g] + [0] * (3 - len(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][:size]


def test_language_equals_plain_profiles(spark):
    from sensortracks.llm.langid import identify_documents

    docs = documents()
    learned = {}
    for d, t, lang in docs:
        if lang is not None and rest(d, 4) != 2:
            learned.setdefault(lang, Counter()).update(plain_grams(t))
    profiles = {k: {g: i for i, g in enumerate(ranked(c, 400))} for k, c in learned.items()}
    got = {r["doc_id"]: r for r in identify_documents(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")).collect()}
    for d, t, _ in docs:
        top = ranked(plain_grams(t), 400)
        apart = {k: sum(abs(p[g] - i) if g in p else 400 for i, g in enumerate(top)) for k, p in profiles.items()}
        best = min(sorted(apart), key=apart.get)
        assert got[d]["lang_pred"] == best and abs(got[d]["score"] - (1 - apart[best] / 400 / len(top))) < 1e-12


def test_language_accuracy_and_edges(spark):
    from sensortracks.llm.langid import identify_documents

    out = identify_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.98
    rows = identify_documents(edge(spark)).collect()
    assert len(rows) == len(EDGE)
    assert all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or "")) for r in rows)
    assert identify_documents(empty(spark)).count() == 0
    unknown = edge(spark).drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in identify_documents(unknown).collect()} == {"und"}


# quality

def test_quality_counts(spark):
    from sensortracks.llm.quality import quality_verdict

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    out = quality_verdict(edge(spark))
    assert {"score", "shard", "_words"} <= set(out.columns)
    assert by_text(out.collect(), "text", *names) == sorted([(r[1], *quality(r[1])) for r in EDGE], key=repr)
    assert quality_verdict(empty(spark)).count() == 0
    more = ["a b c\n" * 40, "a b c d " * 20, "w " * 60, "\n".join(f"line {i % 3} of it" for i in range(60)),
            " ".join(f"w{i}%%%" for i in range(80)), " ".join(f"{i}" * 3 for i in range(80))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(more)], "doc_id long, text string")
    assert by_text(quality_verdict(df).collect(), "text", *names) == sorted([(t, *quality(t)) for t in more], key=repr)


def test_cascade_order_does_not_change_the_verdict(spark):
    from sensortracks.llm.quality import cascade, cascade_order, default_rules, with_base_counts

    df = with_base_counts(spark.read.parquet(f"{SF}/documents.parquet"))
    rules = default_rules()
    order = [r["rule"] for r in cascade_order(df, rules, 50)]
    assert sorted(order) == sorted(rules)
    a, b = cascade(rules, order).isNull(), cascade(rules, order[::-1]).isNull()
    assert df.filter(a != b).count() == 0 and df.filter(~a).count() > 0


# BPE

ODD = ["", " ", "  a  b", "a <|endoftext|>b <|endoftext|>", "it's  we'll\n\n  x\t y z  q", "ab" * 2000, "\x1c \x1f a",
       "٣٤ x", "日本語 \U0001f642\U0001f642", " " * 500, "a \x85b", "x" * 63 + " " + "y" * 64 + " " + "z" * 65]


def test_bpe_equals_the_library():
    from sensortracks.llm.bpe import Encoder
    from sensortracks.llm.pack import Ids

    library, own, fast = Tokenizer.from_file(BPE), Encoder(BPE), Ids(BPE)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab '\n\tc1é<|> .") for _ in range(rng.randint(0, 80))) for _ in range(500)]
    texts += [t for _, t, _ in documents()]
    for text, ids in zip(texts, own.encode_many(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want == fast(text).tolist()
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)
    for word in {w.encode() for t in texts for w in own.words.findall(t)}:
        if 2 <= len(word) <= 64:
            assert own.merge_words([word])[0].tolist() == own.merge_word(word)


def test_bpe_edges(spark):
    from sensortracks.llm.bpe import digests, encode_decode

    rows = encode_decode(edge(spark), BPE).collect()
    assert by_text(rows, "decoded") == sorted([(r[1] or "",) for r in EDGE], key=repr)
    assert {r["n_tokens"] for r in rows if not r["text"]} == {0}
    assert digests(empty(spark), BPE).count() == 0


# personal data

def plain_spans(t):
    from sensortracks.llm.pii import luhn

    out = []
    for k, p in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                           r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))
                    or k == 2 and not (14 <= len(d) <= 19 and luhn(d)) or k == 3 and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    from sensortracks.llm.pii import base_spans

    rng = random.Random(3)
    for size, signs in ((40, "a.@@-+ 1029()%é."), (60, "4111 1-")):
        for _ in range(5000):
            t = "".join(rng.choice(signs) for _ in range(rng.randint(0, size)))
            assert base_spans(t) == plain_spans(t)
    assert base_spans("a" * 50_000 + "1" * 50_000 + "@") == []


def test_field_finds_the_best_segmentation():
    from sensortracks.llm.pii import KINDS, Field, labelled, segment, zones

    texts = [f"call +1 (555) 010-{i:04d} or {i}.{i + 1}.3.4 x{i}@b{i}.org and 41111111{i:04d}" for i in range(40)]
    field = Field().learn([x for t in texts for x in labelled(t)])
    text = "+1 (555) 010-1234 10.2.3.4 joe@b.org 12"
    zone = zones(text)[0]
    best = -math.inf
    for cuts in itertools.product([False, True], repeat=len(zone) - 1):
        ends = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(zone)]
        total = 0.0
        for i, j in zip(ends, ends[1:]):  # noqa: B905
            span = segment(text, zone, i, j - 1) if j - i <= 6 else None
            options = [0.0] if j - i == 1 else []
            total += max(options + (field.scores(text[span[0]:span[1]]) if span else []), default=-math.inf)
        best = max(best, total)
    got = field.best(text, zone)
    assert abs(sum(field.scores(text[a:b])[k] for a, k, b in got) - best) < 1e-9
    assert [(KINDS[k], text[a:b]) for a, k, b in got] == [("phone", "+1 (555) 010-1234"), ("ip", "10.2.3.4"), ("email", "joe@b.org")]


def test_personal_report(spark):
    from sensortracks.llm.pii import KINDS, report

    rows = report(edge(spark)).collect()
    assert len(rows) == len(EDGE)
    one = next(r for r in rows if r["doc_id"] == 14)
    assert (one["n_email"], one["n_ip"], one["n_card"], one["n_phone"]) == (1, 1, 1, 1)
    assert report(empty(spark)).count() == 0
    got = {r["doc_id"]: r for r in report(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for d, t, _ in documents():
        base = plain_spans(t)
        assert [got[d][f"n_{k}"] for k in KINDS] == [sum(s[1] == i for s in base) for i in range(4)]
        assert {f"{KINDS[k]}:{a}:{b}" for a, k, b in base} <= set(got[d]["spans"].split(","))


# temporary names

def test_columns_named_like_temporaries_stay(spark):
    from sensortracks.llm.bpe import encode_decode
    from sensortracks.llm.langid import identify, language_profiles
    from sensortracks.llm.neardup import deduplicated
    from sensortracks.llm.quality import quality_verdict

    extra = ["_p", "_c", "_words", "_q_lines", "_q_windows", "_q_starts", "_kd", "_kt", "_kn"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).selectExpr(
        "doc_id", "text", "lang", *[f"concat('x{i}-', doc_id) AS {c}" for i, c in enumerate(extra)]).cache()
    want = {r["doc_id"]: tuple(r[c] for c in extra) for r in docs.collect()}
    for out in (identify(docs, language_profiles(docs)), encode_decode(docs, BPE), quality_verdict(docs), deduplicated(docs)):
        assert set(extra) <= set(out.columns)
        got = {r["doc_id"]: tuple(r[c] for c in extra) for r in out.collect()}
        assert got and all(got[d] == want[d] for d in got)
    docs.unpersist()


# HTML

def test_main_text_of_the_pages(spark):
    import html

    from sensortracks.llm.htmltext import extract

    for r in extract(spark.read.parquet(f"{SF}/pages.parquet")).collect():
        article = r["html"].split("<article>", 1)[1].split("</article>", 1)[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split())
                  for x in re.split(r"</?(?:p|h1|ul|li|div|table|tr|h2|pre)\b[^>]*>", article)]
        assert r["text"] == "\n\n".join(x for x in blocks if x)


def test_main_text_of_odd_pages(spark):
    from sensortracks.llm.htmltext import extract, main_text

    body = "<p>Long text that is the content of it all.</p><p>Ok.</p><p>Another long text of the content of it all.</p>"
    page = (f"<header class='site'>x</header><div class=cookie-notice><p>We use cookies and much more of that kind.</p></div>"
            f"<div><div class=post>{body}</div><div id=comments><p>I like this very very much, truly yours.</p></div></div>"
            f"<form><p>Sign in here, with your name and all</p></form><script>var a = '<p>no</p>';</script>")
    want = "Long text that is the content of it all.\n\nOk.\n\nAnother long text of the content of it all."
    assert main_text(page) == want
    assert main_text(None) == main_text("") == main_text("<nav><li>a</nav>") == ""
    assert main_text("a&nbsp;b &lt;c") == "a b <c"
    assert main_text("<article><p>One &amp; <b>two<p>three") == "One & two\n\nthree"
    assert len(main_text("<p>" + LONG)) == len(LONG)
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, body, "y")], "page_id long, html string, text string")
    assert by_text(extract(df).collect(), "page_id", "text") == [(1, ""), (1, ""), (2, want)]
    assert extract(df.limit(0)).count() == 0


def test_main_text_keeps_every_region():
    from sensortracks.llm.htmltext import main_text

    menu = "".join(f"<div><a href=/{i}>Item {i}</a></div>" for i in range(12))
    paras = [f"Paragraph {i} of the story, which goes on for a good while and says what has to be said." for i in range(20)]
    sections = [paras[:13], paras[13:]]
    inner = "".join("<section>" + "".join(f"<p>{x}</p>" for x in s) + "</section>" for s in sections)
    want = "\n\n".join(["The title of it", *paras])
    page = f"<body><div>{menu}</div><div class=post><h1>The title of it</h1>{inner}</div><div>{menu}</div></body>"
    assert main_text(page) == want
    page = f"<body><div>{menu}</div><div class=post><p>{' '.join(paras)}</p>{inner}</div><div>{menu}</div></body>"
    got = main_text(page).split("\n\n")
    assert set(got) >= {" ".join(paras), *paras} and "Item 3" not in got
    # a second region outside <article> is content too, a short article does not decide
    page = (f"<body><div>{menu}</div><div id=a><article><p>{paras[0]}</p><p>{paras[1]}</p><p>{paras[2]}</p></article>"
            f"<section><p>{paras[3]}</p><p>{paras[4]}</p></section></div><div>{menu}</div></body>")
    assert main_text(page) == "\n\n".join(paras[:5])


def plain_main_text(lines, names):
    """The method again, with loops: ratios, smoothing, two means, region, names."""
    def low(p):
        return any(n in names for n in p)

    ratio = [0.0 if f else len(t) / max(n, 1) * (0.1 if low(p) else 1) for t, n, f, p in lines]
    even = []
    for i in range(len(ratio)):
        w = {j: math.exp(-((i - j) ** 2) / 2) for j in range(max(0, i - 3), min(len(ratio), i + 4))}
        even.append(sum(w[j] * ratio[j] for j in w) / sum(w.values()))
    means, cut = (min(even), max(even)), 0.0
    while means[0] < means[1]:
        cut = sum(means) / 2
        sides = [[x for x in even if x <= cut], [x for x in even if x > cut]]
        if not all(sides) or (new := tuple(sum(s) / len(s) for s in sides)) == means:
            break
        means = new
    marked = [k for k, (t, _, f, _) in enumerate(lines) if t and not f and even[k] > cut and ratio[k] > cut]
    marked = [k for k in marked if not low(lines[k][3])] or marked
    paths = [lines[k][3] for k in marked]
    holds = paths[0] if paths else ()
    while any(p[:len(holds)] != holds for p in paths):
        holds = holds[:-1]
    if paths and not holds and all(paths):
        chars = {top: sum(len(lines[k][0]) for k in marked if lines[k][3][0] == top) for top in {p[0] for p in paths}}
        best = max(chars, key=chars.get)
        alone = all(sum(bool(t and not f and p[:1] == (top,)) for t, _, f, p in lines) == 1 for top in chars if top != best)
        if chars[best] > sum(chars.values()) / 2 and alone:
            paths = [p for p in paths if p[0] == best]
            holds = paths[0]
            while any(p[:len(holds)] != holds for p in paths):
                holds = holds[:-1]
    return "\n\n".join(t for t, _, f, p in lines if t and not f and p[:len(holds)] == holds and not low(p[len(holds):]))


def unnamed(page):
    """A page without class, id and role, whose furniture tags are plain boxes."""
    return re.sub(r"<(/?)(nav|footer|header|aside|form)\b", r"<\1div", re.sub(r' (class|id|role)="[^"]*"', "", page))


def test_main_text_is_its_method(spark):
    from sensortracks.llm.htmltext import main_text, page_lines

    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    for page in pages + [unnamed(p) for p in pages]:
        assert main_text(page) == plain_main_text(*page_lines(page))


def test_clusters_choose_the_content(spark, monkeypatch):
    from sensortracks.llm import htmltext

    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    want = [htmltext.main_text(p) for p in pages]
    right = sum(htmltext.main_text(unnamed(p)) == w for p, w in zip(pages, want, strict=True))
    assert right >= 0.98 * len(pages)
    monkeypatch.setattr(htmltext, "threshold", lambda values: -1.0)  # clusters off: every line is marked
    assert sum(htmltext.main_text(unnamed(p)) == w for p, w in zip(pages, want, strict=True)) < 0.02 * len(pages)


def test_names_are_evidence_only():
    from sensortracks.llm.htmltext import main_text

    body = "<h1>The title</h1><p>Some text of the story that is long enough to be read.</p><p>Ok.</p>"
    want = "The title\n\nSome text of the story that is long enough to be read.\n\nOk."
    for name in ("share-price-story", "notice-of-meeting", "notice", "promo box"):
        assert main_text(f'<nav><li>a</nav><div class="{name}">{body}</div><footer>x y z</footer>') == want
    for name in ("ad", "site-footer", "share-buttons", "cookie-notice", "newsletter signup"):
        page = f'<div>{body}<div class="{name}"><p>Text that is as long as the story, or longer even, by far.</p></div></div>'
        assert main_text(page) == want


def test_threshold_splits_two_clusters():
    from sensortracks.llm.htmltext import smoothed, threshold

    values = np.array([0.0, 1, 0, 20, 22, 21])
    assert 1 < threshold(values) < 20
    assert np.allclose(smoothed(np.ones(7)), 1) and isinstance(pd.Series(smoothed(values)).max(), float)
