"""Golden micro-cases and properties of the column functions."""

import pytest
from pyspark.sql import functions as F

from docloom.config import Site
from docloom.functions import citations as C
from docloom.functions import html as H
from docloom.functions import text as T
from docloom.functions import urls as U
from docloom.functions.chunk import chunks


@pytest.fixture
def of(spark):
    """Value of a column function on one string (or None)."""

    def run(f, value):
        return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]

    return run


def test_normalize(of):
    assert of(T.normalize, "سَلامـ: abc 12") == "سلام 12"
    assert of(T.normalize, "ﻻ") == "لا"
    assert of(T.normalize, "ا\xa0 ب\n\n\nج؟ !") == "ا ب\nج؟ !"  # NFKC makes the first space plain
    assert of(T.normalize, None) is None
    once = of(T.normalize, "ab س،ص  ـ x\n\n١٢")
    assert of(T.normalize, once) == once


def test_gates(of):
    assert of(lambda c: T.letter_gate(c, 3), "ابت") and not of(lambda c: T.letter_gate(c, 4), "ابت") and not of(T.letter_gate, None)
    assert not of(lambda c: T.length_gate(c, 3), " \xa0ab ") and of(lambda c: T.length_gate(c, 2), " \xa0ab ")
    assert of(T.is_arabic, "ا" * 30) and not of(T.is_arabic, "ا" * 30 + "a" * 121) and not of(T.is_arabic, None)


def test_headings(of):
    assert of(T.is_heading, "مقدمة عامة") and not of(T.is_heading, "باب")
    raw = "تعريف المرض: عام"
    assert of(T.is_heading, raw) and not of(lambda c: T.is_heading(T.normalize(c)), raw)
    assert not of(T.is_heading, "أولاً نبدأ هنا") and of(T.is_heading, "أولاًنبدأ")
    assert not of(lambda c: T.is_heading(T.normalize(c)), "أولاً نبدأ هنا") and not of(T.is_heading, None)


def test_sentences(of):
    assert of(T.sentences, "a. b؟ c؛ d? e!f") == ["a", "b", "c؛ d? e", "f"]
    assert [len(x) for x in of(T.bounded_sentences, "ب" * 310)] == [150, 150, 10]
    assert of(T.bounded_sentences, "ا" * 100 + "، " + "ب" * 160) == ["ا" * 100, "ب" * 160]
    assert of(T.lines, "a\r\n\n b \x1cc") == ["a", "b", "c"]


def test_chunks(of):
    pack = lambda n, **k: lambda c: chunks(c, n, **k)
    assert of(pack(10), "aaaa. bbbb. cccc") == ["aaaa bbbb", "cccc"]
    assert of(pack(300), "نص اول. مقدمة عامة. نص ثان") == ["نص اول", "مقدمة عامة نص ثان"]
    assert of(pack(21), "مقدمة عامة. aaaaaaaaaa") == ["مقدمة عامة", "aaaaaaaaaa"]  # a heading counts one more
    assert of(pack(10), None) == of(pack(10), " \n") == of(pack(10), "...") == []
    assert of(pack(10), "x" * 40) == ["x" * 40]
    assert of(pack(15, overlap=1), "aaaa. bbbb. cccc. dddd") == ["aaaa bbbb cccc", "cccc dddd"]


def test_chunks_keep_units_in_order(of):
    text = ". ".join(f"unit {k} " + "y" * (k * 7 % 60) for k in range(60))
    units, got = of(T.bounded_sentences, text), of(lambda c: chunks(c, 100), text)
    assert " ".join(got) == " ".join(units) and all(len(c) <= 100 for c in got)


def test_urls(of):
    assert of(U.canonical, "HTTPS://Ex.com/a;p=1?q=2#f") == "https://Ex.com/a?q=2"
    assert of(U.canonical, "https://ex.com/a?") == "https://ex.com/a" and of(U.canonical_stripped, " https://ex.com/a b ") == "https://ex.com/a b"
    assert of(U.is_pdf, "https://ex.com/A.PDF") and not of(U.is_pdf, "https://ex.com/a.pdf?x=1")
    assert of(U.uid, "https://example.com/x") == "4701cd48f501"
    site = Site(domain="ex.com", section="/health/", excluded_prefixes=("/Images/",))
    ok = lambda u: of(lambda c: U.is_internal(c, site), u)
    assert ok("https://WWW.ex.com/ar/Health/x") and not ok("https://ex.com/en/health/x") and not ok("https://ex.com/images/health/x")
    assert not ok("https://ex.com:80/health/x") and not ok("https://other.com/health/x") and not ok(None)
    assert of(U.is_html, "Text/HTML; charset=x") and not of(U.is_html, "image/png") and not of(U.is_html, None)


PAGE = '<html><head><title>no</title><script>var t="</p>";location.href = "/health/r"</script></head><body><nav>menu <a href="/health/n">n</a></nav>%s<iframe src="f/g"></iframe><div data-url="/health/d;x=1#y">t</div>"https://ex.com/health/q?a&amp;b"</body></html>'


def test_html(spark, of):
    long = PAGE % ("<article><p>" + "word &amp; " * 40 + "</p></article> <p>after</p>")
    short = PAGE % "<article>short</article><p>after</p>"
    for f in (H.main_text, H.main_text_exact):
        assert of(f, long) == ("word & " * 40).strip()
        assert of(f, short).startswith("short after t") and "menu" not in of(f, short) and "no" not in of(f, short).split()
    assert H.tree_text("<p>a<b>b") == "a b" and H.tree_text("") == "" and of(H.main_text_exact, None) is None
    site = Site(domain="ex.com", section="/health/")
    rows = spark.createDataFrame([("https://ex.com/health/", PAGE % "", 1), (None, None, 2)], "url string, html string, dst int")
    got = {r["dst"] for r in H.page_links(rows, site=site).collect()}
    assert got == {"https://ex.com/health/" + x for x in ("n", "f/g", "d", "r", "q?a&b")}


def test_citations(of):
    assert of(C.citation_ids, "[1] [12] [١] [1234] [[2]] [0]") == [0, 1, 2, 12] and of(C.citation_ids, None) == []
    got = of(lambda c: C.citation_validity(c, F.lit(3)), "[0] [2] [5]")
    assert (got["valid"], got["invalid"]) == (False, [0, 5])
    got = of(lambda c: C.citation_validity(c, F.lit(3)), "none")
    assert (got["valid"], got["used"], got["invalid"]) == (False, [], [])
    assert of(C.abstained, "قال: لا تتوفر معلومات كافية للإجابة.") and not of(C.abstained, "x")
    assert tuple(of(C.split_answer, " text ")) == ("text", "")
    assert tuple(of(C.split_answer, "a\n\n### 📚 المصادر المستخدمة:\n- x ")) == ("a", "### 📚 المصادر المستخدمة:\n- x")


@pytest.mark.parametrize(("cell", "want"), [('["a"," b ",""]', ["a", "b"]), ("a; b;", ["a", "b"]), (" ", []), (None, []), ("[x", ["[x"])])
def test_reference_cells(of, cell, want):
    assert of(C.parse_references, cell) == want


def test_references_and_labels(of):
    s = lambda x, kind="string": F.lit(x).cast(kind)
    ref = lambda *a: of(lambda c: C.reference(s(a[0]), s(a[1]), s(a[2], "int"), s(a[3]), s(a[4])), "")
    assert ref("PDF_page", "r", 3, None, None) == "PDF:r:p3" and ref("PDF_page", "r", None, None, None) == "PDF:r"
    assert ref("web_page", None, None, None, None) == "URL:UNKNOWN" and ref(None, "x", None, None, None) == "SRC:x"
    assert ref("web_page", None, None, "", "https://e.com/a#b") == "URL:https://e.com/a"
    assert of(lambda c: C.source_label(s("PDF_page"), s("r"), s(None)), "") == "PDF:r" and of(lambda c: C.source_label(s(None), s(None), s(None)), "") == "UNKNOWN"
