"""Text functions against expected values."""

import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from trovelight.functions import arrow as A
from trovelight.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("混凝土", ["混凝土", "混凝", "凝土"]),
        ("钢筋", ["钢筋", "钢筋"]),
        ("梁", ["梁"]),
        ("预应力混凝土结", ["预应", "应力", "力混", "混凝", "凝土", "土结"]),
        ("a钢b筋", ["钢", "筋"]),
        ("，。", []),
        ("𠀀𠀁", ["𠀀𠀁", "𠀀𠀁"]),
    ],
)
def test_cjk_tokens(spark, text, tokens):
    assert one(spark, T.cjk_tokens("t"), t=text) == tokens


@pytest.mark.parametrize(
    ("text", "tokens"),
    [("Concrete beam", ["concrete", "beam"]), ("the concrete", ["concrete"]), ("混凝土 beam", ["混凝土", "混凝", "凝土", "beam"]), ("foo_bar x", ["foo_bar"]), ("beam beam", ["beam", "beam"]), (None, []), ("éreier", ["reier"])],
)
def test_fts_tokens(spark, text, tokens):
    assert one(spark, T.fts_tokens("t"), t=text) == tokens


@pytest.mark.parametrize("mark", [*T.K.INDEX_PUNCTUATION[0], "\u33ff", "\u3400", "\u9fff", "\U0010ffff", "\U00020000", "é", "K", "İ", ""])
def test_tokens_at_marks(spark, mark):
    """Marks that are brought to one form cut tokens as before; characters at the ends of the CJK ranges are seen."""
    text = f"钢{mark}筋{mark}混凝{mark}ab{mark}C_d{mark}the {mark} x{mark}"
    plain = text.translate(str.maketrans(*T.K.INDEX_PUNCTUATION))
    words = [w.lower() for w in re.findall("[A-Za-z0-9_]{2,}", plain)]
    want = [*one(spark, T.cjk_tokens("t"), t=plain), *words]
    assert one(spark, T.fts_tokens("t"), t=text) == [w for w in want if w not in T.K.ENGLISH_STOP_WORDS | T.K.CJK_STOP_WORDS]


def test_words_are_cut_cheaply(spark):
    """Texts aren't copied mark by mark, nor tokens sorted by an interpreted comparison; counts are those of the tokens."""
    docs = spark.createDataFrame([("b a_b b 钢筋 A_B zz b",), ("",), (None,)], "t string").select(T.counted(T.fts_tokens("t")).alias("c"))
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and "sort_array(" in plan and "array_sort(" not in plan
    assert [[tuple(x) for x in r.c] for r in docs.collect()] == [[("a_b", 2), ("zz", 1), ("钢筋", 2)], [], []]


def test_index_terms(spark):
    assert one(spark, T.index_terms("t"), t=["foo_bar", "_x_", "a"]) == ["foo", "bar", "x", "a"]


@pytest.mark.parametrize(
    ("text", "terms", "most", "window"),
    [("abcdef", ["x"], 4, "abcd"), ("abc", ["b"], 10, "abc"), ("0123456789" * 5, ["9"], 9, "… 678901234 …"), ("aaaXbbb", ["X"], 3, "… aXb …"), ("", ["x"], 5, "")],
)
def test_extract_window(spark, text, terms, most, window):
    assert one(spark, T.extract_window("t", F.col("w"), most), t=text, w=terms) == window


def test_markdown_to_plain(spark):
    md = "# Title\n\n`code` and [link](http://x) **bold** __b__ *i*  \n"
    assert one(spark, T.markdown_to_plain("t"), t=md) == "Title\n\ncode and [link] bold b i\n"
    assert one(spark, T.markdown_to_plain("t"), t="") == "\n"


def test_frontmatter(spark):
    md = '---\nid: "x:1"\ntitle: A: b\nid: y\n---\n\nbody'
    assert one(spark, T.frontmatter("t"), t=md) == {"title": "A: b", "id": "y"}
    assert one(spark, T.strip_frontmatter("t"), t=md) == "body"
    assert one(spark, T.frontmatter("t"), t="---\nno end") == {}
    assert one(spark, T.strip_frontmatter("t"), t="plain") == "plain"


@pytest.mark.parametrize(("title", "file", "version"), [("Standard V2", "a_V3.md", "v2"), ("Standard", "doc V7.md", "v7"), ("Standard", "doc_v2.md", "current"), (None, "v12 x", "v12")])
def test_source_version(spark, title, file, version):
    assert one(spark, T.source_version("a", "b"), a=title, b=file) == version


@pytest.mark.parametrize(("query", "key"), [("预应力 混凝土", "混凝土 预应力"), ("B a, b!", "a b"), ("", ""), ("Étage É", "é étage")])
def test_query_key(spark, query, key):
    assert one(spark, T.query_key("q"), q=query) == key


def test_alias_form(spark):
    assert one(spark, T.alias_form(A.nfkc("t")), t="ＡＢＣ-混凝土 1") == "abc混凝土1"
    assert one(spark, T.core_title("t"), t="第十二条 抗震 设计") == "抗震 设计"


@pytest.mark.parametrize(("numeral", "value"), [("十二", 12), ("二十", 20), ("一百零三", 103), ("三千二百", 3200), ("7", 7), ("十", 10)])
def test_cn_number(spark, numeral, value):
    assert one(spark, T.cn_number("t"), t=numeral) == value


def test_normalized_query(spark):
    q = one(spark, T.normalized_query(A.nfkc("q")), q="  第 十二 条 ，ABC  （ x ） ")
    assert q == unicodedata.normalize("NFKC", q)
    assert one(spark, T.article_terms("q"), q="参见第十二条和第3条、第十二条") == ["第12条", "第3条"]


@pytest.mark.parametrize(("query", "tokens"), [("foo/bar-baz a", ["foo", "bar", "baz"]), ("林黛玉葬花", ["林黛玉葬花", "林黛", "黛玉", "玉葬", "葬花"]), ("one two three four five six seven", ["one", "two", "three", "four", "five", "six"])])
def test_grep_tokens(spark, query, tokens):
    assert one(spark, T.grep_tokens("q"), q=query) == tokens


def test_tolerant_pattern(spark):
    p = T.tolerant_pattern("a,b。(c)")
    assert one(spark, F.col("t").rlike(p), t="xa，b.(c)")
    assert not one(spark, F.col("t").rlike(p), t="xa;b.(c)")


@pytest.mark.parametrize(
    ("text", "md"),
    [
        ("Title\n===\nbody text that goes on and on", "# Title\nbody text that goes on and on\n"),
        ("Part\n---", "## Part\n"),
        ("Chapter One\n\nx", "# Chapter One\n\n### x\n"),
        ("1.2.3 Load\n\n- item\n\n1. item", "### 1.2.3 Load\n\n- item\n\n1. item\n"),
        ("第三章 荷载", "# 第三章 荷载\n"),
        ("a\nb", "a\nb\n"),
    ],
)
def test_inferred_headings(spark, text, md):
    assert one(spark, T.inferred_headings("t"), t=text) == md


def test_inferred_headings_of_many_lines(spark):
    """Work grows with a text's lines, not with their third power: 1500 lines, underlines among them, take a moment."""
    lines = ["" if k % 2 else f"Line {k}" for k in range(1500)]
    text = "\n".join([*lines, "Title", "===", "---", "end"])
    began = time.monotonic()
    found = one(spark, T.inferred_headings("t"), t=text)
    assert time.monotonic() - began < 20
    assert found == "\n".join([*(f"### {x}" if x else "" for x in lines), "## # Title", "end"]) + "\n"


def test_keywords(spark):
    assert one(spark, T.keywords("t", 8, 2), t="beam beam column column column the the") == ["column", "beam"]
    assert one(spark, T.keywords("t", 3, 2), t="混凝土混凝土混凝土")[:2] == ["混凝土", "混凝土混凝土"]
    assert one(spark, T.keywords("t", 8, 2), t="once") == [] == one(spark, T.keywords("t", 8, 2), t="")
    assert one(spark, T.keywords("t", 2, 2), t="aa aa bb bb cc cc cc") == ["cc", "aa"]


def test_smallest_window():
    assert A.smallest_window("alpha x beta .......... alpha beta", ["alpha", "beta"]) == 6
    assert A.smallest_window("alpha", ["alpha", "beta"]) is None


@pytest.mark.parametrize("data", ["héllo".encode(), "héllo".encode("utf-8-sig"), "héllo".encode("cp1252")])
def test_decode(data):
    assert A.decode(data).startswith("h")


def test_decode_gb18030():
    assert A.decode("混凝土结构".encode("gb18030")) == "混凝土结构"


def test_neighbor_heuristic(spark):
    for q, n in (("施工步骤", 2), ("混凝土的定义", 0), ("尺寸", 1), ("beam", 1)):
        assert one(spark, T.neighbor_heuristic("q"), q=q) == n


def test_truthy_and_numbers(spark):
    assert one(spark, T.truthy("v"), v=" YES ") and not one(spark, T.truthy("v"), v="0") and one(spark, T.truthy("v"), v="")
    assert one(spark, T.trailing_number("v"), v="chunk-012") == 12
    assert one(spark, T.alias_list("v"), v='["a","b","a"]') == ["a", "b"]
    assert one(spark, T.alias_list("v"), v="a，b; c、a") == ["a", "b", "c"]
