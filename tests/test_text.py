import pytest
from pyspark.sql import functions as F

from askloom.functions import text as tx


def test_characters(one):
    assert one(tx.fix_characters, "a b​c “x” — eﬁx\x07\ty\n") == 'a bc "x" - efix\ty\n'


def test_messy_text(one):
    out = one(lambda c: tx.strip(tx.clean_basic(c)), "a   b​\t\tc\n\n\n\n  d  \r\ne")
    assert out == "a b c\n\nd\ne"


@pytest.mark.parametrize("text, joined", [("the infor-\nmation was", "the information was"), ("café-\nél", "caféél"), ("a -\nb", "a -\nb"), ("infor-\r\nmation", "information")])
def test_hyphens(one, text, joined):
    assert one(lambda c: tx.dehyphenate(tx.fold_newlines(c)), text) == joined


def test_tokens(one):
    assert one(tx.tokens, "RAG-based, 42 times! don't") == ["rag", "based", "42", "times", "don't"]


def test_filler_words_do_not_count(one):
    assert one(tx.content_terms, "tell me about mathematics") == ["mathematics"]
    cover = lambda a, b: tx.coverage(tx.content_terms(a), tx.content_terms(b))
    assert one(cover, "tell me about mathematics", "mathematics is old") == 1.0
    assert one(cover, "what is the objective", "the objective is stated") == 1.0
    assert one(cover, "what is the", "unrelated") == 1.0
    assert one(cover, "red green", "only red") == 0.5


@pytest.mark.parametrize("name, title", [("Experiment_5_DAV.docx", "Experiment 5 DAV Experiment 5 DAV"), ("PaperNLPClassifier.pdf", "Paper NLP Classifier Paper NLP Classifier"), ("___.pdf", "___")])
def test_titles(one, name, title):
    assert one(tx.title_context, name) == title


def test_names(one):
    assert one(tx.safe_filename, "dir\\lab report.txt") == "lab_report.txt"
    assert one(tx.safe_filename, "___") == "upload"
    assert one(tx.file_extension, "a/B.TXT") == "txt"
    assert one(tx.file_extension, ".hidden") == ""
    assert one(tx.stored_doc_id, "doc_ab12cd_lab_report.txt") == "doc_ab12cd"
    assert one(tx.stored_name, "doc_ab12cd_lab_report.txt") == "lab_report.txt"
    assert one(tx.stored_doc_id, "plain.txt") is None
    assert one(tx.slugify, " Hello, World! ") == "hello_world"
    assert one(lambda c: tx.truncate(c, 8), "hello world") == "hello..."
    assert one(lambda c: tx.truncate_filename(c, 16), "a_very_long_name_indeed.pdf") == "a_very_long....pdf"


@pytest.mark.parametrize("size, text", [("0", "0 B"), ("1023", "1023 B"), ("1536", "1.5 KB"), ("1468006", "1.4 MB"), ("3221225472", "3.0 GB")])
def test_sizes(one, size, text):
    assert one(lambda c: tx.human_size(c.cast("double")), size) == text


@pytest.mark.parametrize("ms, text", [(None, "-"), ("250", "250 ms"), ("1500", "1.50 s"), ("61000", "1m 1s")])
def test_durations(one, ms, text):
    assert one(lambda c: tx.format_duration(c.cast("double")), ms) == text


@pytest.mark.parametrize("at, text", [(None, "never"), ("2024-01-01 00:00:00", "just now"), ("2023-12-31 23:57:00", "3 minutes ago"), ("2023-12-31 00:00:00", "yesterday"), ("2024-01-01 02:00:00", "just now")])
def test_relative_time(one, at, text):
    assert one(lambda a, b: tx.relative_time(a.cast("timestamp"), b), at, "2024-01-01 00:00:00") == text


def test_highlight(one):
    parts = one(tx.highlight, "The Red fox is red-ish", "red is")
    assert [(p["text"], p["hit"]) for p in parts] == [("The ", False), ("Red", True), (" fox is ", False), ("red", True), ("-ish", False)]
    assert [(p["text"], p["hit"]) for p in one(tx.highlight, "abc", "a b")] == [("abc", False)]


@pytest.mark.parametrize("line", ["2 Related Work", "2. Related Work", "2.1 Sycophancy", "4.1.2 Setup"])
def test_headings(one, line):
    assert one(tx.is_heading, line) is True
    assert one(tx.is_heading, line.lower() + " and so on it goes.") is False


def test_quick_looks_change_nothing(spark):
    """Cleaning looks first whether a pattern is needed; the texts are those of the plain patterns."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r", "\r\n", "-\n", " ", "\u0085", "\x1c", "\x0b", "\x0c", "\x07", "\x7f", "\x00", "a", "b", "é", "_", "ﬁ", "“", "​", "\U0001f600", "　", " ", "5"]
    rows = spark.createDataFrame([(None,), ("",), *[("".join(rng.choices(parts, k=rng.randint(1, 12))),) for _ in range(3000)]], "t string")
    plain = {
        "strip": lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", ""),
        "dehyphenate": lambda t: F.regexp_replace(t, r"(?U)(\w)-\n(\w)", "$1$2"),
        "fold_newlines": lambda t: F.regexp_replace(t, "\r\n?", "\n"),
        "collapse_whitespace": lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t\f\x0B]+", " "), r"(?U)(^|\n)[^\S\n]+", "$1"), r"(?U)[^\S\n]+(\n|$)", "$1"), "\n{3,}", "\n\n"),
    }
    for name, by in plain.items():
        found = getattr(tx, name)(F.col("t"))
        assert "CASE WHEN" in str(found._jc.toString()).upper() or "transform" in str(found._jc.toString())
        assert rows.filter(~by(F.col("t")).eqNullSafe(found)).count() == 0, name


def test_highlight_makes_terms_once(spark):
    """The query's terms are bound outside of the parts."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("The Fox ate a foxglove", "fox the, ate"), ("nothing", "a b"), ("x", None), (None, "fox")], "t string, q string")
    found = rows.select(tx.highlight(F.col("t"), F.col("q")).alias("p"))
    assert str(found._jdf.queryExecution().optimizedPlan().toString()).count("split(lower") == 1
    got = [r["p"] if r["p"] is None else [(x["text"], x["hit"]) for x in r["p"]] for r in found.collect()]
    assert got[0] == [("The", True), (" ", False), ("Fox", True), (" ", False), ("ate", True), (" a ", False), ("fox", True), ("glove", False)]
    assert got[1] == [("nothing", False)] and got[3] is None


def test_strip_looks_at_all_white_space(spark):
    """Ends of one byte or several, blank or not; a text with plain ends is not counted through."""
    ends = ["", " ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u3000", "\u200b", "é", "\u4e00", "!", "~", "\x7f", "\U0001f600"]
    rows = [(a + body + b,) for a in ends for b in ends for body in ("", "x", "x y é")] + [(None,)]
    frame = spark.createDataFrame(rows, "t string")
    plain = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    assert frame.filter(~tx.strip(F.col("t")).eqNullSafe(plain)).count() == 0
    assert "as binary" in frame.select(tx.strip(F.col("t")))._jdf.queryExecution().analyzed().toString()
