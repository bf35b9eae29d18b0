"""Scalar functions, span algebra and rendering, by example and against simple models."""

import html
import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions.stemmer import stem
from marginalia.functions import cites, spans, text

KINDS = ("underline", "highlight")


def evaluate(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [r.asDict(recursive=True) for r in df.select(*(c.alias(n) for n, c in columns.items())).collect()]


def one(spark, value, fn, kind="string"):
    return evaluate(spark, [(value,)], f"x {kind}", out=fn(F.col("x")))[0]["out"]


@pytest.mark.parametrize("raw,want", [(None, ""), ("", ""), ("Smith & Co. 22", "smithco22"), ("É a", "a")])
def test_identifier(spark, raw, want):
    assert one(spark, raw, text.identifier) == want


@pytest.mark.parametrize("raw,want", [(None, ""), (" HTTP://X.org/A/?q=1#f ", "http://x.org/a/?q=1"), ("http://x.org///", "http://x.org"), ("http://x.org/#a#b", "http://x.org")])
def test_url_normal(spark, raw, want):
    assert one(spark, raw, text.url_normal) == want


@pytest.mark.parametrize("raw,want", [("A > B", ["A", "B"]), ("A › B", ["A", "B"]), ("A›B", ["A", "B"]), ("A, B,,C", ["A", "B", "C"]), ("A > B, C", ["A", "B, C"]), ("", []), (None, []), ("  ", []), ("Lone", ["Lone"])])
def test_header_path(spark, raw, want):
    assert one(spark, raw, text.header_path) == want


@pytest.mark.parametrize("raw,want", [(None, "Other"), ("  ", "Other"), ("---", "Other"), ("1NC Negative", "Neg"), ("neg", "Neg"), ("AFF", "Aff"), ("Affirmative---Case", "Aff"), ("Case---X", "CaseX")])
def test_heading_side(spark, raw, want):
    assert one(spark, raw, text.heading_side) == want


@pytest.mark.parametrize("n,want", [(0, "0:00"), (42, "0:42"), (95, "1:35"), (600, "10:00"), (-5, "0:00"), (3661, "61:01")])
def test_minutes(spark, n, want):
    assert one(spark, n, text.minutes, "int") == want


@pytest.mark.parametrize("raw,want", [("My list", "My_list.docx"), ("", "workspace.docx"), (None, "workspace.docx"), ("a/b:c", "a_b_c.docx"), ("__x__", "x.docx"), ("é", "workspace.docx")])
def test_safe_filename(spark, raw, want):
    assert one(spark, raw, text.safe_filename) == want


@pytest.mark.parametrize("raw,want", [(None, "/workspaces"), ("", "/workspaces"), ("/cards/1", "/cards/1"), ("//evil", "/workspaces"), ("/\\evil", "/workspaces"), ("https://evil", "/workspaces"), ("/login", "/workspaces"), ("/login/?next=/x", "/workspaces"), ("/loginx", "/loginx"), ("/search?q=//x", "/search?q=//x"), ("javascript:x", "/workspaces")])
def test_safe_redirect(spark, raw, want):
    assert one(spark, raw, text.safe_redirect) == want


@pytest.mark.parametrize(
    "name,want",
    [
        ("North-AB-Aff-01---Big-Cup-Round-3.docx", ("North", "AB", "Aff", "Big Cup", "Round 3", "01")),
        ("North-AB-Neg-3.-Open-Finals.docx", ("North", "AB", "Neg", "Open", "Finals", "3")),
        ("North-AB-Neg-State-Classic-semis.docx", ("North", "AB", "Neg", "State Classic", "semis", None)),
        ("North-AB-Aff-12-Round-Robin-Round-Robin.docx", ("North", "AB", "Aff", "Round Robin", "Round-Robin", "12")),
        ("North-AB-Aff-Plain", ("North", "AB", "Aff", "Plain", None, None)),
        ("North-AB-Aff-.docx", ("North", "AB", "Aff", None, None, None)),
        ("North-AB-Aff-Cup.DOCX", ("North", "AB", "Aff", "Cup.DOCX", None, None)),
        ("North-AB-Con-Cup.docx", None), ("North-AB.docx", None), ("notes.docx", None), (None, None),
    ],
)
def test_disclosure_name(spark, name, want):
    got = one(spark, name, text.disclosure_name)
    assert (tuple(got.values()) if got else None) == want


@pytest.mark.parametrize(
    "raw,short,author,year",
    [
        ("Smith 22 (professor of law at a well known school, 2022)", "Smith 22", "Smith", 2022),
        ("Smith and Jones, '98, in a journal", "Smith and Jones, '98", "Smith & Jones", 1998),
        ("Lee et al. 3/14/21 text", "Lee et al. 3/14/21", "Lee", 2021),
        ("no author here at all", "no author here at", "no", None),
        ("", "(unknown)", "(unknown)", None), (None, "(unknown)", "(unknown)", None),
        ("Müller—2019", "Müller—2019", "Müller", 2019),
        ("Brown 1776 and 2024", "Brown 1776", "Brown", 2024),
        ("X 1999-2004", "X 1999", "X", 1999),
        ("X 3000 2004", "X 3000", "X", None),  # the space belongs to the first number
    ],
)
def test_cites(spark, raw, short, author, year):
    got = one(spark, raw, cites.parse_cite)
    assert (got["cite_short"], got["author"], got["year"]) == (short, author, year)


def test_cite_title_url_and_qualifications(spark):
    got = one(spark, 'Smith 22 [senior fellow at an institute, "A title of this text", https://x.org/a.html).] "short" “A much longer title of another text”', cites.parse_cite)
    assert got["url"] == "https://x.org/a.html" and got["title"] == "A much longer title of another text"
    assert got["qualifications"].startswith("senior fellow at an institute")


def test_tag_and_cite_quality(spark):
    tags = {"Growth is good for the whole world.": 0.8, "": 0.0, "2NC---T": 0.0, "1. Short": 0.2, "[a] Some words here make a claim": 0.45, "SCREAMING LETTERS are quite bad here now": 0.6}
    got = evaluate(spark, [(t,) for t in tags], "x string", x=F.col("x"), s=F.round(text.tag_quality(F.col("x"), F.lit("f.docx")), 6))
    assert {r["x"]: r["s"] for r in got} == tags
    assert evaluate(spark, [("My File", "dir/My File.docx")], "a string, b string", s=F.round(text.tag_quality(F.col("a"), F.col("b")), 6))[0]["s"] == pytest.approx(0.1)
    rows = [("Smith 22", 2022, 0.9), ("Richard van Carrier 22", 2022, 0.47 + 0.1 - 0.0), ("x", None, 0.0), (None, 1999, 0.0), ("Smith et al., 1999", 1999, 0.97)]
    got = evaluate(spark, [r[:2] for r in rows], "c string, y int", c=F.col("c"), s=F.round(text.cite_quality(F.col("c"), F.col("y")), 6))
    assert got[0]["s"] == 0.9 and got[2]["s"] == 0.0 and got[3]["s"] == 0.0 and got[4]["s"] == pytest.approx(0.97)


def test_clean_cite(spark):
    cases = {
        "Smith 22,": "Smith 22", "Smith et. al 22": "Smith et al. 22", "Smith ET. AL 22": "Smith et al. 22", "Smith et al 22": "Smith et al 22", "Smith et. al. 22": "Smith et al.. 22", "Smith, 22": "Smith 22", "Smith,\u00a0 22 ; ": "Smith 22",
        "Smith and Jones 22": "Smith & Jones 22", "Mark Smith 22": "Smith 22", "Bartholomew Smith 22": "Bartholomew Smith 22", "Mark Smith and Jones, 22": "Smith & Jones 22",
    }
    for raw, want in cases.items():
        assert one(spark, raw, text.cleaned_cite) == want, raw
    for raw, want in {"Smith '22": "Smith", "Smith 6": "Smith", "Lee 6/9": "Lee", "Lee 3/14/2022": "Lee", "Lee 3-14-22": "Lee", "Smith": "Smith", "Smith 20221": "Smith 2"}.items():
        assert one(spark, raw, text.author_without_year) == want, raw


def test_stems_of_the_published_sample():
    words = "consigned consistency consolatory consolidating conspicuously conspiracy constables knackeries knavish kneeled knights knives knocker generously hoping hopping happy flies died policies relational skies dying news proceed"
    stems = "consign consist consolatori consolid conspicu conspiraci constabl knackeri knavish kneel knight knive knocker generous hope hop happi fli die polici relat sky die news proceed"
    assert [stem(w) for w in words.split()] == stems.split()


def test_snippet(spark):
    body = "a" * 100 + "Needle" + "b" * 300
    rows = [(body, "needle"), (body, "zzz"), (body, ""), (body, None), ("short", "or"), (None, "x")]
    got = [r["s"] for r in evaluate(spark, rows, "t string, q string", s=text.snippet(F.col("t"), F.col("q")))]
    assert got[0] == "…" + "a" * 60 + "Needle" + "b" * 180 + "…"
    assert got[1] == got[2] == got[3] == body[:240] + "…" and got[4] == "short" and got[5] is None


def test_jaccard_of_words(spark):
    rows = [(["a"], ["a", "b"]), ([], []), ([], ["a"])]
    assert [r["j"] for r in evaluate(spark, rows, "a array<string>, b array<string>", j=text.jaccard(F.col("a"), F.col("b")))] == [0.5, 1.0, 0.0]
    assert one(spark, "The cat's claims, and CLAIMS of it; a-b no", text.content_words) == ["cat's", "claims", "a-b"]


def test_accounts(spark):
    names = [("ok",), (" ok ",), ("a b",), ("",), (None,), ("x" * 33,)]
    assert [r["v"] for r in evaluate(spark, names, "n string", v=text.valid_nickname(F.col("n")))] == [True, True, False, False, False, False]
    assert [r["v"] for r in evaluate(spark, [("1234567",), ("12345678",), (None,)], "p string", v=text.valid_password(F.col("p")))] == [False, True, False]


# Spans against a model of one bit for each place and kind.
def bits(list_, n=60):
    return {(k, p) for s in list_ or [] for k in KINDS if s["kind"] == k for p in range(max(0, s["start"]), min(n, s["end"]))}


def random_spans(rng, most=8):
    return [{"start": a, "end": a + rng.randrange(-2, 15), "kind": rng.choice(KINDS)} for a in (rng.randrange(0, 45) for _ in range(rng.randrange(most)))]


def is_normal(list_):
    keys = [(s["start"], s["kind"]) for s in list_]
    apart = all(b["start"] > a["end"] for k in KINDS for a, b in zip([s for s in list_ if s["kind"] == k], [s for s in list_ if s["kind"] == k][1:]))
    return keys == sorted(keys) and apart and all(s["start"] < s["end"] for s in list_)


def test_span_laws(spark):
    rng = random.Random(7)
    rows = [(random_spans(rng), random_spans(rng), rng.randrange(0, 50), rng.randrange(0, 50), rng.choice(KINDS)) for _ in range(300)] + [(None, None, 0, 5, "underline"), ([], [], 5, 5, "highlight")]
    a, b, lo, hi, k = (F.col(c) for c in ("a", "b", "lo", "hi", "k"))
    got = evaluate(
        spark, rows, f"a {spans.SPANS}, b {spans.SPANS}, lo int, hi int, k string", a=a, b=b, lo=lo, hi=hi, k=k,
        norm=spans.normalize(a), twice=spans.normalize(spans.normalize(a)), union=spans.union(a, b), covers=spans.covers(spans.union(a, b), spans.normalize(a)),
        clear=spans.apply_op(a, F.lit("clear"), lo, hi, F.lit(None).cast("string")), add=spans.apply_op(a, F.lit("add"), lo, hi, k), back=spans.apply_op(spans.apply_op(a, F.lit("add"), lo, hi, k), F.lit("clear"), lo, hi, k),
    )
    for r in got:
        assert is_normal(r["norm"]) and r["twice"] == r["norm"] and bits(r["norm"]) == bits(r["a"])
        assert is_normal(r["union"]) and bits(r["union"]) == bits(r["a"]) | bits(r["b"]) and r["covers"]
        if r["lo"] >= r["hi"]:
            assert r["clear"] == (r["a"] or []) and r["add"] == (r["a"] or [])
            continue
        span = range(r["lo"], r["hi"])
        assert is_normal(r["clear"]) and bits(r["clear"]) == {x for x in bits(r["a"]) if x[1] not in span}
        kinds = KINDS if r["k"] == "highlight" else ("underline",)
        assert is_normal(r["add"]) and bits(r["add"]) == bits(r["a"]) | {(k2, p) for k2 in kinds for p in span}
        assert r["back"] == r["clear"]


def test_span_jaccard_is_over_raw_triples(spark):
    s = lambda a, b, k="underline": {"start": a, "end": b, "kind": k}
    rows = [([s(0, 5), s(5, 9)], [s(0, 9)]), ([s(0, 5)], [s(0, 5), s(0, 5)]), (None, []), ([s(0, 1)], None)]
    assert [r["j"] for r in evaluate(spark, rows, f"a {spans.SPANS}, b {spans.SPANS}", j=spans.jaccard(F.col("a"), F.col("b")))] == [0.0, 1.0, 1.0, 0.0]


def test_render_modes(spark):
    s = lambda a, b, k: {"start": a, "end": b, "kind": k}
    markup = [s(0, 9, "underline"), s(4, 9, "highlight"), s(12, 13, "highlight")]
    rows = [("one two & <x>", markup), ("a<b", []), ("a<b", None)]
    t, m = F.col("t"), F.col("m")
    got = evaluate(spark, rows, f"t string, m {spans.SPANS}", full=spans.render(t, m), hl=spans.render(t, m, "highlight-only"), ul=spans.render(t, m, "underline-only"), plain=spans.render(t, m, "plain"))
    assert got[0]["full"] == '<u class="ul">one </u><mark class="hl">two &amp;</mark> &lt;x<mark class="hl">&gt;</mark>'
    assert got[0]["hl"] == '<mark class="hl">two &amp;</mark> <span class="ellipsis">…</span> <mark class="hl">&gt;</mark>'
    assert got[0]["ul"] == '<u class="ul">one </u><mark class="hl">two &amp;</mark>'
    assert got[1] == {"full": "a&lt;b", "hl": "", "ul": "", "plain": "a&lt;b"} == got[2]
    with pytest.raises(ValueError):
        spans.render(t, m, "other")


def test_rendering_works_each_list_out_once():
    t, m = F.col("t"), F.col("m")
    for mode in ("full", "underline-only"):
        shown = spans.render(t, m, mode)._jc.toString()
        assert shown.lower().count("array_distinct") == 1 and "array_sort" not in shown.lower(), mode


def test_render_of_crossing_spans_equals_character_by_character(spark):
    rng, kinds = random.Random(3), ("highlight", "underline", "bold")
    text = "a<b> & 'c' \"d\" é"
    cases = [[(rng.randrange(-2, 20), rng.randrange(-2, 24), rng.choice(kinds)) for _ in range(rng.randrange(6))] for _ in range(60)]
    cases = [[(max(0, a), max(0, b), k) for a, b, k in c] for c in cases]
    esc = lambda c: html.escape(c, quote=True)

    def full(body, marks):
        edges, out = sorted({0, len(body), *(a for a, _, _ in marks), *(b for _, b, _ in marks)}), ""
        for x, y in zip(edges, edges[1:]):
            on = {k for a, b, k in marks if a <= x and b >= y}
            tag = ('<mark class="hl">', "</mark>") if "highlight" in on else ('<u class="ul">', "</u>") if "underline" in on else ("", "")
            out += tag[0] + esc(body[x:y]) + tag[1]
        return out

    def lines(body, marks):
        lights = [(a, b) for a, b, k in marks if k == "highlight"]
        whole = sorted(((a, i, b) for i, (a, b, k) in enumerate(marks) if k == "underline" and a < b), key=lambda u: u[:2])
        cut = lambda a, b: [(0, b - a, "underline")] + [(max(h, a) - a, min(i, b) - a, "highlight") for h, i in lights if max(h, a) < min(i, b)]
        return ' <span class="ellipsis">…</span> '.join(full(body[a:b], cut(a, b)) for a, _, b in whole)

    rows = [(text, [{"start": a, "end": b, "kind": k} for a, b, k in c]) for c in cases]
    got = evaluate(spark, rows, f"t string, m {spans.SPANS}", full=spans.render(F.col("t"), F.col("m")), ul=spans.render(F.col("t"), F.col("m"), "underline-only"))
    assert [(r["full"], r["ul"]) for r in got] == [(full(text, c), lines(text, c)) for c in cases]


@pytest.mark.parametrize("n,want", [(0, 0), (1, 1), (9, 2), (270, 60), (135, 30)])
def test_reading_seconds(spark, n, want):
    assert one(spark, n, spans.reading_seconds, "int") == want


def test_reading_seconds_round_half_to_even(spark):
    got = evaluate(spark, [(5,), (15,), (25,)], "x int", s=spans.reading_seconds(F.col("x"), wpm=600))
    assert [r["s"] for r in got] == [1, 2, 2]


def test_reading_text(spark):
    s = lambda a, b, k="highlight": {"start": a, "end": b, "kind": k}
    rows = [("alpha beta gamma", [s(6, 10), s(0, 5), s(0, 16, "underline"), s(3, 3)]), ("alpha", [s(0, 2), s(2, 5)]), ("alpha", None)]
    got = evaluate(spark, rows, f"t string, m {spans.SPANS}", r=spans.reading_text(F.col("t"), F.col("m")), w=spans.reading_words(F.col("t"), F.col("m")))
    assert [tuple(r.values()) for r in got] == [("alpha beta", 2), ("al pha", 2), ("", 0)]


@pytest.mark.parametrize("peer,head,want", [("1.1.1.1", "2.2.2.2", "1.1.1.1"), ("10.0.0.1", "2.2.2.2, 3.3.3.3", "2.2.2.2"), ("10.0.0.1", "", "10.0.0.1"), ("10.0.0.1", None, "10.0.0.1"), ("10.0.0.1", "junk", "10.0.0.1"), ("fd00::1", "::5", "::5"), ("junk", "2.2.2.2", "junk"), (None, "2.2.2.2", "0.0.0.0")])
def test_client_ip(spark, peer, head, want):
    from marginalia.functions.network import client_ip

    got = evaluate(spark, [(peer, head)], "p string, h string", ip=client_ip(F.col("p"), F.col("h"), ["10.0.0.0/8", "fd00::/8", "nonsense"]))
    assert got[0]["ip"] == want


def test_tag_quality_works_its_parts_out_once(spark):
    """Before, the tag and its words were worked out again for each rule that looks at them."""
    import re

    odd = ["", " ", "a", " one two　three  four ", "ABCDEF GHIJKL x", "ABCDEF_ GHIJKL", "xABCDEF GHIJKLm", "ABCDEFG\nHIJKLMN", "ABCDEF-GHIJKL.", "ÄABCDEF GHIJKL", "ABCDEF1 ABCDEFG, ABCDEFGH", "[a] x y z w q r.", "12. a b c d e f\n", "Ends?\n", "src", "src ", "A---b", "w " * 51, "x\x0by\x85z", 'Said "so"', None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "id int, t string").coalesce(1)

    def quality(t):
        words = len(re.findall(r"\S+", t))  # Python's blanks are those of the pattern, but for four that aren't here
        caps = sum(bool(re.fullmatch("[A-Z]{6,}", w)) for w in re.split(r"[^\w]+", t))
        s = 0.5 - 0.4 * ("---" in t) - 0.25 * bool(re.match(r"\s*\[[^\]]{0,4}\]\s", t)) - 0.15 * bool(re.match(r"\s*\d{1,2}[.)\-]\s", t)) - 0.3 * (t.strip() == "src")
        s += 0.2 if 6 <= words <= 30 else -0.15 if words < 4 else -0.1 if words > 50 else 0
        return max(0.0, min(1.0, s + 0.05 * t[:1].isupper() + 0.05 * (t[-1:] in tuple('.?!”"')) - 0.15 * (caps >= 2))) if t else 0.0

    got = df.select("id", text.tag_quality(F.col("t"), F.lit("src.docx")).alias("q"), text.word_count(F.col("t")).alias("n")).collect()
    assert [round(r.q, 6) for r in got] == [round(quality(t or ""), 6) for t in odd] and [r.n for r in got] == [len((t or "").split()) for t in odd]
    plan = df.select(text.tag_quality(F.concat("t", F.lit("#")), F.lit("src.docx")).alias("q"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(") == 1


def test_blanks_are_the_same_characters_everywhere(spark):
    df = spark.createDataFrame([(k, f"{chr(k)}a{chr(k)}b{chr(k)}{chr(k)}") for k in [*range(0x3100), 0x1D7D8, 0x1F600, 0xFEFF] if not 0xD800 <= k < 0xE000], "k int, t string")
    old = F.regexp_replace("t", rf"^{text.BLANK}+|{text.BLANK}+$", "")
    told = df.select("k", text.strip(F.col("t")).alias("s"), old.alias("old"), text.word_count(F.col("t")).alias("n"), F.size(F.split(old, rf"{text.BLANK}+")).alias("m"))
    assert told.where("s <> old or n <> m").count() == 0 and told.where("n = 2").count() == 25
