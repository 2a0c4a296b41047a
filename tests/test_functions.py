"""Scalar functions against known values."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import notation, distance, markup, numbers, text, textmodel
from lodestone.plans.pipeline import Pipeline, ensemble, grid, sweep


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


L = F.lit


def test_text(spark):
    assert one(spark, text.merge_spaces(L("  a \n\tb  "))) == "a b"
    assert one(spark, text.after(L("a=b=c"), "=")) == "b=c" and one(spark, text.after(L("abc"), "=")) == ""
    assert one(spark, text.before(L("a=b=c"), "=")) == "a" and one(spark, text.before(L("abc"), "=")) == "abc"
    assert one(spark, text.trim_text(L("one two three"), 8)) == "one two..." and one(spark, text.trim_text(L("one"), 8)) == "one"
    assert one(spark, text.trim_text(L("abcdefghijkl"), 5)) == "..."
    assert one(spark, text.strip_tags(L("<i>one</i> <u>two</u>"))) == "one two"
    assert one(spark, text.strip_tags(L("<i>one</i> <u>two</u>"), allow=["u"])) == "one <u>two</u>"
    assert one(spark, text.strip_elements(L("<i>one</i>x<u>two</u>"), ["i"])) == " x<u>two</u>"
    assert one(spark, text.html_to_text(L("<p>A &amp; B</p><p>c</p>"))) == "A & B c"
    assert one(spark, text.html_to_text_smart(L("<p>in<b>line</b></p>"))) == "inline"
    assert one(spark, text.stopwords(L("This is an example string."))) == "example string"
    assert one(spark, text.char_ngrams(L("abcde"), 4)) == ["abcd", "bcde"] and one(spark, text.char_ngrams(L("abc"), 4)) == []
    assert one(spark, text.find_emails(L("me (at) kot.ac.uk, x@y.com x@y.com"))) == ["me@kot.ac.uk", "x@y.com"]
    assert one(spark, text.ascii_fold(L("żółć Éa"))) == "zoc Ea"
    assert one(spark, text.html_attr_escape(L("<a b='1'>&"))) == "&lt;a b=&#39;1&#39;&gt;&amp;"
    assert one(spark, text.prefix("-", L(""))) == "" and one(spark, text.indent(L("a\nb"), "  ")) == "  a\n  b"
    assert text.alternative(["a.b", "c"]) == r"(?:a\.b|c)"
    assert one(spark, text.short_id_value(text.short_id(L(123456789)))) == 123456789
    assert one(spark, text.url_join(L("http://a.b/c/d"), L("../e"))) == "http://a.b/e"
    assert one(spark, text.fix_url(L("a.b"))) == "http://a.b" and one(spark, text.fix_url(L(""))) is None
    assert one(spark, text.set_extension(L("a/b.tar.gz"), "txt")) == "a/b.tar.txt" and one(spark, text.drop_extensions(L("a/b.tar.gz"))) == "a/b"
    assert one(spark, text.is_issn(L("1234-567X")))
    assert one(spark, text.extract_regex(L("a1 b2"), r"([a-z])(\d)")) == ["a", "1", "b", "2"]


def test_languages(spark):
    a, b = text.tagged(L("x"), L("HTML")), text.tagged(L("y"), L("HTML/plain"))
    r = one(spark, text.combine(a, b))
    assert (r["text"], r["language"]) == ("xy", "HTML")
    with pytest.raises(Exception, match="languages"):
        one(spark, text.combine(a, text.tagged(L("y"), L("plain"))))


def test_numbers(spark):
    assert one(spark, numbers.hash_md5(L("Ala ma kota"), 3)) == 9508390
    assert one(spark, numbers.hash_md5(L("Ala ma kota"), 7)) == 40838224789264552
    assert one(spark, numbers.hash_md5(L("Ala ma kota"), 12)) == Decimal(int(__import__("hashlib").md5(b"Ala ma kota").hexdigest()[:24], 16))
    assert one(spark, F.round(numbers.distance_km(L(52.0), L(21.0), L(51.0), L(0.0)), 3)) == 1451.869
    assert one(spark, numbers.div_up(L(5), 2)) == 3 and one(spark, numbers.round_up(L(-7), 5)) == -5 and one(spark, numbers.round_up(L(7), 5)) == 10
    assert one(spark, numbers.binarize(L(2.0))) == 1.0 and one(spark, numbers.bound(L(None).cast("double"), 0.0, 1.0)) is None
    assert one(spark, F.round(numbers.mexican(L(0.0)), 3)) == 0.867
    assert one(spark, numbers.parse_int(L("1,234 567"))) == 1234567 and one(spark, numbers.as_int(L("x"), 3)) == 3
    assert one(spark, F.round(numbers.parse_percent(L("32.1%")), 6)) == 0.321
    s = one(spark, numbers.softmax(F.array(L(1.0), L(2.0))))
    assert abs(sum(s) - 1) < 1e-12
    assert one(spark, numbers.unit_norm(F.array(L(3.0), L(4.0)))) == [0.6, 0.8]
    assert one(spark, numbers.find_nonzero(F.array(L(0), L(2), L(3)))) == [1, 2]
    assert one(spark, numbers.vector_of_json(numbers.vector_json(F.array(L(1.5), L(2.0))))) == [1.5, 2.0]


def test_dates(spark):
    for s, day in (("2001-02-03", (2001, 2, 3)), ("03.02.2001", (2001, 2, 3)), ("02/03/2001", (2001, 2, 3)), ("Feb 3, 2001", (2001, 2, 3)), ("20010203", (2001, 2, 3)), ("200102", (2001, 2, 1)), ("2001", (2001, 1, 1))):
        assert one(spark, numbers.parse_date(L(s))) == dt.date(*day), s
    assert one(spark, numbers.parse_date(L("31.31.2001"))) is None
    assert one(spark, numbers.format_date(L("0313-01-01").cast("date"))) == "313-01-01"
    a, b = L("2001-01-01").cast("timestamp"), L("2001-01-02 00:00:00.5").cast("timestamp")
    assert one(spark, numbers.seconds_between(a, b)) == 86400.5 and one(spark, numbers.seconds_between(a, L(None).cast("timestamp"))) is None


@pytest.mark.parametrize("a,b,case,space,want", [("Ala", "OLa", 1, 1, 2), ("Ala", "OLa", 0.5, 1, 1.5), (" a ala", "aala ", 1, 0.1, 0.3), (" a ala Ola ", "aalaola ", 1, 2, 7)])
def test_edit_distance(a, b, case, space, want):
    assert distance.edit_distance(a, b, case, space) == pytest.approx(want)


@settings(max_examples=60, deadline=None)
@given(st.text("abAB ", max_size=8), st.text("abAB ", max_size=8))
def test_edit_distance_properties(a, b):
    d = distance.edit_distance(a, b, 0.5, 0.3)
    assert d == pytest.approx(distance.edit_distance(b, a, 0.5, 0.3)) and (d == 0) == (a == b)
    m = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            m[i][j] = min(m[i - 1][j] + 1, m[i][j - 1] + 1, m[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    assert distance.edit_distance(a, b) == m[-1][-1]


def test_leven_and_alignment(spark):
    assert one(spark, distance.leven_dist(L("Alama"), L("ALA"))) == pytest.approx(0.5 + 0.1)
    assert one(spark, distance.leven_score(L("Alama"), L("ALA"))) == pytest.approx(0.4)
    a, b, d = distance.align_pair("to align", "align two")
    assert (len(a), a.replace("_", ""), b.replace("_", ""), d) == (len(b), "to align", "align two", 7.0)
    assert distance.align_many(["aabbcc", "aadcc", "aaeecc"], gap_cost=2.0) == ["aabbcc", "aad_cc", "aaeecc"]
    assert distance.find_substring("kota", "Ala ma kota!") == (7, 11, 0.0)
    assert distance.align_many([]) == []


def test_folded_text_is_taken_in_pieces(spark, monkeypatch):
    texts = ["żółć Éa", None, "plain", "", "ﬁ½Ⅷ日", "x" * 50] * 7
    want = ["zoc Ea", None, "plain", "", "fi12VIII", "x" * 50] * 7
    monkeypatch.setattr(text, "PIECE", 100)
    seen, real = [], text._folded
    monkeypatch.setattr(text, "_folded", lambda s: seen.append(s) or real(s))
    assert text.ascii_fold.func(pa.array(texts)).to_pylist() == want and len(seen) == len(texts)
    assert text.ascii_fold.func(pa.array([], pa.string())).to_pylist() == []
    got = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", text.ascii_fold("s").alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == want and one(spark, text.ascii_fold(L("żó"))) == "zo"


CUT = "A &amp;&amp &copy;&copy &#65;&#65 &notit; &AMP;lt; &"
DECODED = "A &&amp \u00a9&copy A&#65 &notit; &lt; &"


def test_entities_end_with_a_semicolon(spark):
    assert one(spark, text.decode_entities(L(CUT))) == DECODED and one(spark, text.decode_entities(F.lit(None).cast("string"))) is None
    assert one(spark, text.html_to_text(L(f"<h1>{CUT}</h1>&quo"))) == DECODED + " &quo"
    assert one(spark, text.html_to_text_smart(L(f"<b>{CUT}</b>x"))) == DECODED + "x"
    assert markup.Pattern("<title>{TITLE ..}</title>").match(f"<title> {CUT}</title>") == {"TITLE": DECODED}
    page = f"<p><a title='{CUT}\ufdd0' b&amp=1>{CUT}</a><script>a &&amp b</script></p>"
    assert one(spark, markup.node_texts(L(page), "a")) == [DECODED] and one(spark, markup.node_text(L(page), "a", "title")) == DECODED + "\ufdd0"
    assert one(spark, markup.node_text(L(page), "script")) == "a &&amp b" and one(spark, markup.parsed_text(L(page))) == DECODED + "a &&amp b"


def test_patterns(spark):
    p = markup.Pattern("<table> {* <tr><td>{ARTICLE ..}</td><td>{PRICE}</td></tr> } </table>")
    doc = "<TABLE class='x'> <tr><td>Pen</td><td>1</td></tr> <tr><td> Red  Pencil</td><td>2</td></tr></table>"
    assert p.match(doc) == {"ARTICLE": ["Pen", "Red Pencil"], "PRICE": ["1", "2"]}
    assert markup.Pattern('<a href="{URL}">{TEXT ..}</a>').match('<a class="k" href="/u?a=1&amp;b">An &amp; b</a>') == {"URL": "/u?a=1&b", "TEXT": "An & b"}
    assert markup.Pattern("x[ y {Y~\\d+}]").match("x") == {"Y": None} and markup.Pattern("x{Y~\\d+}").match("y") is None
    assert markup.Pattern("{N~\\d*}").match_all("1a2")[0] == {"N": "1"}
    with pytest.raises(markup.PatternError):
        markup.Pattern("{A x")
    assert one(spark, markup.pattern_match(L("<b>k</b>"), "<b>{K}</b>")) == {"K": "k"}
    assert one(spark, markup.node_texts(L("<div class='a b'><p>x<br>y</p><p id=q>z</div>"), "div.b > p")) is not None
    assert one(spark, markup.node_text(L("<div><p id=q>z</p></div>"), "#q")) == "z"
    assert one(spark, markup.anchors(L("<a href=/x>1</a><a>2</a>"))) == ["/x"]


VALUES = [None, True, 3, -2.5, "żółć \"q\"\n", [1, [2, None]], (1,), (1, 2), {None: 1, "k": [2]}, {1, 2}, dt.datetime(2001, 2, 3, 4, 5, 6), dt.date(1, 2, 3), dt.time(1, 2, 3), notation.Record("T", {"a": 1, "b": [2]}), Decimal("1.50"), b"xy", [], {}, ()]


@pytest.mark.parametrize("layout", [0, 1, 2])
def test_notation_round_trip(layout):
    for v in VALUES:
        assert notation.decode(notation.encode(v, layout)) == v, v
    a = notation.decode(notation.encode(np.array([[1, 2], [3, 4]])))
    assert a.tolist() == [[1, 2], [3, 4]]
    assert list(notation.load("\n".join(notation.encode(v, layout) for v in VALUES if v != ()))) == [v for v in VALUES if v != ()]


def test_notation_reads_no_code(spark):
    assert notation.decode("os.system(cmd=\"ls\")") == notation.Record("os.system", {"cmd": "ls"})
    with pytest.raises(notation.NotationError):
        notation.decode("[1, 2")
    assert one(spark, notation.notation_decode(L("{\"a\": [1, ~]}")).cast("string")) == '{"a":[1,null]}'


def test_one_hot(spark):
    assert one(spark, textmodel.one_hot(L("b"), ["a", "b"])) == [0.0, 1.0]
    assert one(spark, textmodel.one_hot(L(None).cast("string"), ["a", "b"])) == [0.0, 0.0]
    with pytest.raises(Exception, match="unknown class"):
        one(spark, textmodel.one_hot(L("c"), ["a", "b"]))
    assert one(spark, textmodel.decode(F.array(L(0.1), L(0.4)), ["a", "b"], 0.5)) is None


def test_words_model_and_same_text(spark):
    d = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a", "c"])], "id bigint, w array<string>")
    m = textmodel.words_model(d, "id", "w").collect()
    assert [(r["word"], r["df"], r["idf"]) for r in m] == [("a", 2, 0.0)]


def test_pipeline_and_grid(spark):
    p = Pipeline("comment", None) >> (lambda d: d.filter("id > 1")) >> (lambda d: d.withColumn("y", F.col("id") * 2))
    assert [r["y"] for r in p.fetch(spark.range(4))] == [4, 6]
    out, seen = p.observed(spark.range(4))
    out.collect()
    assert [o.get["rows"] for o in seen] == [2, 2]
    assert grid({"a": [1, 2], "b": [3, 4]})[1] == {"a": 1, "b": 4}
    r = sweep(spark.range(10), {"lo": [3, 7]}, lambda lo: F.sum((F.col("id") >= lo).cast("int"))).collect()
    assert {(x["lo"], x["metric"]) for x in r} == {(3, 7), (7, 3)}
    assert one(spark, ensemble(L(1.0), L(None).cast("double"), L(2.0))) == 1.5
    with pytest.raises(TypeError):
        Pipeline(3)
