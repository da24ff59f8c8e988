"""Text functions as Column expressions: everything here runs inside the JVM.

Offsets and lengths are code points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

_CJK = K.cjk_class()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def empty_strings() -> Column:
    return F.array().cast("array<string>")


# --- tokens -----------------------------------------------------------------


def has_cjk(text: Column | str) -> Column:
    return _col(text).rlike(f"[{_CJK}]")


def cjk_tokens(text: Column | str) -> Column:
    """Of each CJK run: itself if it has 2 to 6 characters, then its 2-grams; a lone character is kept."""
    runs = F.regexp_extract_all(_col(text), F.lit(f"[{_CJK}]+"), F.lit(0))

    def of_run(run: Column) -> Column:
        n = F.char_length(run)
        whole = F.when(n.between(2, 6), F.array(run)).otherwise(empty_strings())
        grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
        return F.concat(whole, grams)

    return F.flatten(F.transform(runs, of_run))


def fts_tokens(text: Column | str, stop_words: Iterable[str] | None = None) -> Column:
    """CJK tokens, then lower-cased runs of two or more of [A-Za-z0-9_]; stop words go, repeats stay.

    Of K.INDEX_PUNCTUATION no mark, and nothing it is brought to, is in a token, so texts are cut as they are. Most have no
    character from the first CJK range on, which one comparison a character tells.
    """
    stop = sorted(K.ENGLISH_STOP_WORDS | K.CJK_STOP_WORDS if stop_words is None else set(stop_words))
    plain = F.coalesce(_col(text), F.lit(""))
    words = F.transform(F.regexp_extract_all(plain, F.lit("[A-Za-z0-9_]{2,}"), F.lit(0)), F.lower)
    cjk = F.when(plain.rlike(f"[\\x{{{K.CJK_RANGES[0][0]:X}}}-\\x{{10FFFF}}]"), cjk_tokens(plain)).otherwise(empty_strings())
    found = F.concat(cjk, words)
    return F.filter(found, lambda t: ~t.isin(*stop)) if stop else found


def index_terms(tokens: Column | str) -> Column:
    """Terms that the index holds: tokens cut at underscores. Tokens without any are the terms."""
    cut = lambda ts: F.filter(F.flatten(F.transform(ts, lambda t: F.split(t, "_"))), lambda t: t != "")
    return _let(_col(tokens), lambda ts: F.when(F.array_join(ts, " ").contains("_") | F.array_contains(ts, ""), cut(ts)).otherwise(ts))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also where use names it inside functions over arrays."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def counted(tokens: Column) -> Column:
    """An array of (token, n) for each distinct token, by token."""

    def of_sorted(s: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        run = lambda o: lambda a, k: F.struct(F.get(s, a).alias("token"), (F.coalesce(F.get(o, k + 1), F.size(s)) - a).alias("n"))
        return F.when(F.size(s) > 0, _let(opens, lambda o: F.transform(o, run(o)))).otherwise(F.array().cast("array<struct<token: string, n: int>>"))

    # sort_array() compares strings itself, array_sort() by an expression that is interpreted for each pair.
    return _let(F.sort_array(tokens), of_sorted)


def keywords(text: Column | str, top_k: int = 8, min_freq: int = 2) -> Column:
    """Frequent CJK substrings of 2 to 6 characters and words; one inside a longer one chosen before is left out."""
    t = F.coalesce(_col(text), F.lit(""))
    runs = F.regexp_extract_all(t, F.lit(f"[{_CJK}]{{2,}}"), F.lit(0))
    of_length = lambda r, n: F.when(F.char_length(r) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(r) - n + 1, F.lit(1))), lambda i: F.substring(r, i, n))).otherwise(empty_strings())
    grams = F.flatten(F.transform(runs, lambda r: F.flatten(F.transform(F.sequence(F.lit(2), F.lit(6)), lambda n: of_length(r, n)))))
    words = F.transform(F.regexp_extract_all(t, F.lit("[A-Za-z0-9_]{2,}"), F.lit(0)), F.lower)
    found = F.concat(F.filter(grams, lambda g: ~g.isin(*sorted(K.CJK_STOP_WORDS))), F.filter(words, lambda w: ~w.isin(*sorted(K.ENGLISH_STOP_WORDS))))
    frequent = F.filter(counted(found), lambda x: x["n"] >= min_freq)
    order = F.array_sort(F.transform(frequent, lambda x: F.struct((-x["n"]).alias("n"), (-F.char_length(x["token"])).alias("size"), x["token"].alias("token"))))

    def pick(chosen: Column, x: Column) -> Column:
        inside = F.exists(chosen, lambda c: (F.char_length(c) > -x["size"]) & c.contains(x["token"]))
        return F.when((F.size(chosen) >= top_k) | inside, chosen).otherwise(F.concat(chosen, F.array(x["token"])))

    return F.aggregate(order, empty_strings(), pick)


def query_terms(text: Column | str) -> Column:
    return F.filter(F.split(F.coalesce(_col(text), F.lit("")), r"\s+"), lambda t: t != "")


def grep_tokens(query: Column | str, most: int = 6) -> Column:
    """Tokens for a cascade of line searches: split at white space, / and -, two characters or more.

    A query that gives one at most, and has CJK, is cut into 2-grams as well.
    """
    q = F.coalesce(_col(query), F.lit(""))
    parts = F.filter(F.split(F.translate(q, "/-", "  "), r"\s+"), lambda t: F.char_length(t) >= 2)
    solid = F.regexp_replace(q, r"[^\x{4E00}-\x{9FFF}]", "")
    n = F.char_length(solid)
    grams = F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(solid, i, F.lit(2)))).otherwise(empty_strings())
    return F.slice(F.when(F.size(parts) <= 1, F.concat(parts, grams)).otherwise(parts), 1, most)


def count_occurrences(text: Column | str, needle: Column | str) -> Column:
    """Occurrences that don't overlap; none of an empty needle."""
    t, n = F.coalesce(_col(text), F.lit("")), _col(needle)
    gone = F.char_length(t) - F.char_length(F.replace(t, n, F.lit("")))
    return F.when(F.char_length(n) > 0, (gone / F.char_length(n)).cast("long")).otherwise(F.lit(0).cast("long"))


# --- snippets and Markdown --------------------------------------------------


def extract_window(text: Column | str, terms: Column, max_chars: int) -> Column:
    """max_chars of text around the earliest term, a third of them ahead of it; cut ends are marked."""
    t = F.coalesce(_col(text), F.lit(""))
    n = F.char_length(t)
    places = F.filter(F.transform(terms, lambda w: F.when(F.char_length(w) > 0, F.instr(t, w)).otherwise(0)), lambda p: p > 0)

    def around(first: Column) -> Column:
        wanted = F.greatest(F.lit(0), first - 1 - max_chars // 3)
        end = F.least(n, wanted + max_chars)
        start = F.when(end - wanted < max_chars, F.greatest(F.lit(0), end - max_chars)).otherwise(wanted)
        return F.when(first.isNotNull(), _let(F.struct(start.alias("start"), end.alias("end")), marked)).otherwise(F.substring(t, 1, max_chars))

    def marked(at: Column) -> Column:
        cut = F.substring(t, at["start"] + 1, at["end"] - at["start"])
        return F.concat(F.when(at["start"] > 0, F.lit("… ")).otherwise(F.lit("")), cut, F.when(at["end"] < n, F.lit(" …")).otherwise(F.lit("")))

    return _let(F.array_min(places), around)


def markdown_to_plain(md: Column | str) -> Column:
    """Heading marks, back-ticks, emphasis and link targets go; lines are trimmed; one line feed ends the text."""

    def of_line(line: Column) -> Column:
        bare = F.regexp_replace(F.trim(line), r"^#{1,6}\s+", "")
        bare = F.regexp_replace(bare, "`([^`]*)`", "$1")
        bare = F.regexp_replace(bare, r"\[(.*?)\]\((.*?)\)", "[$1]")
        return F.regexp_replace(bare, r"\*\*|__|\*", "")

    lines = F.split(F.coalesce(_col(md), F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", -1)
    return F.concat(F.regexp_replace(F.array_join(F.transform(lines, of_line), "\n"), r"^\s+|\s+$", ""), F.lit("\n"))


def frontmatter(md: Column | str) -> Column:
    """The key: value lines between a leading --- and the next one, as a map; the last of equal keys wins."""
    parts = F.split(F.coalesce(_col(md), F.lit("")), "---", 3)
    lines = F.filter(F.split(F.get(parts, F.lit(1)), "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.regexp_replace(F.trim(F.substring(x, F.instr(x, F.lit(":")) + 1, F.char_length(x))), '^"+|"+$', "").alias("value")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    there = _col(md).startswith("---") & (F.size(parts) == 3)
    return F.when(there, F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>"))


def strip_frontmatter(md: Column | str) -> Column:
    m = F.coalesce(_col(md), F.lit(""))
    parts = F.split(m, "---", 3)
    return F.when(m.startswith("---") & (F.size(parts) == 3), F.regexp_replace(F.get(parts, F.lit(2)), r"^[\r\n]+", "")).otherwise(m)


def html_to_text(html: Column | str) -> Column:
    """Scripts, styles, comments and tags go; the commonest entities are read; runs of white space become one space."""
    t = F.regexp_replace(F.coalesce(_col(html), F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(mark))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


# --- identifiers and digests ------------------------------------------------


def source_version(title: Column | str, filename: Column | str) -> Column:
    """vN from a word V<digits> in the title, else in the file name, else current."""

    def number(c: Column | str) -> Column:
        found = F.regexp_extract(F.coalesce(_col(c), F.lit("")), r"(?i)\bV(\d+)\b", 1)
        return F.when(found != "", F.concat(F.lit("v"), found))

    return F.coalesce(number(title), number(filename), F.lit("current"))


def node_key(node_id: Column | str, version: Column | str) -> Column:
    return F.concat_ws("@", _col(node_id), _col(version))


def short_id(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts as a compact JSON array."""
    told = [F.regexp_replace(F.to_json(F.array(p)), r"^\[|\]$", "") for p in parts]
    return F.substring(F.sha2(F.concat(F.lit("["), F.concat_ws(",", *told), F.lit("]")), 256), 1, 16)


def fingerprint(**fields: Column) -> Column:
    """SHA-256 of the fields as compact JSON with sorted keys; nulls are kept."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def article_reference(label: Column | str) -> Column:
    return F.replace(F.regexp_replace(_col(label), r"\s+", ""), F.lit("條"), F.lit("条"))


def core_title(title: Column | str) -> Column:
    """A title without a leading article number."""
    return F.trim(F.regexp_replace(F.trim(_col(title)), r"^第[0-9一二三四五六七八九十百千]+[条條]\s*", ""))


def alias_form(nfkc: Column | str) -> Column:
    """The normal form of an alias whose text is in NFKC already: lower case, letters a-z, digits and CJK alone."""
    return F.regexp_replace(F.lower(_col(nfkc)), f"[^0-9a-z{_CJK}]", "")


def query_key(query: Column | str) -> Column:
    """What makes two queries the same: distinct words in order, lower-cased, without punctuation."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(_col(query), F.lit(""))), r"[^\p{L}\p{N}]+", " "), " ")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(words, lambda w: w != ""))), " ")


def cache_key(query: Column | str, parameters: Column | None = None) -> Column:
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(_col(query), F.lit(""))), r"\s+", " "))
    return text if parameters is None else F.concat_ws("#", text, F.substring(F.sha2(parameters, 256), 1, 16))


def slug(text: Column | str, most: int = 48) -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), r"[^a-z0-9]+", "-")
    cut = F.regexp_replace(F.substring(F.regexp_replace(bare, r"^-+|-+$", ""), 1, most), r"-+$", "")
    return F.when(cut == "", F.lit("doc")).otherwise(cut)


def title_keywords(title: Column | str) -> Column:
    marks = "".join("\\" + c if ord(c) < 128 else c for c in K.TITLE_MARKS)
    words = "|".join(sorted(K.TITLE_WORDS, key=len, reverse=True))
    parts = F.split(F.trim(_col(title)), rf"[\s{marks}]+|{words}")
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.char_length(p) >= 2))


def chunk_title(chunk_id: Column | str, text: Column | str) -> Column:
    """The id and the first line that isn't blank, without heading marks and double quotes, of 80 characters at most."""
    lines = F.filter(F.split(F.coalesce(_col(text), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    line = F.trim(F.replace(F.regexp_replace(F.trim(F.get(lines, F.lit(0))), r"^#{1,6}\s+", ""), F.lit('"'), F.lit("")))
    cut = F.when(F.char_length(line) > 80, F.concat(F.rtrim(F.substring(line, 1, 80)), F.lit("…"))).otherwise(line)
    return F.when(F.coalesce(cut, F.lit("")) == "", _col(chunk_id)).otherwise(F.concat_ws(" ", _col(chunk_id), cut))


def truthy(value: Column | str, default: bool = True) -> Column:
    v = F.lower(F.trim(_col(value).cast("string")))
    return F.when(v.isNull() | (v == ""), F.lit(default)).otherwise(v.isin("1", "true", "yes", "y", "on"))


def trailing_number(text: Column | str, default: int = 0) -> Column:
    return F.coalesce(F.regexp_extract(_col(text), r"(\d+)$", 1).try_cast("int"), F.lit(default))


def alias_list(value: Column | str) -> Column:
    """A JSON array of strings, or a list split at , ， 、 ; and ；."""
    v = F.coalesce(_col(value), F.lit(""))
    listed = F.when(v.startswith("["), F.from_json(v, "array<string>"))
    parts = F.coalesce(listed, F.split(v, "[,，、;；]"))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""))


def escape_inline(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"([\\`*_\[\]])", r"\\$1")


# --- queries ----------------------------------------------------------------


def cn_number(text: Column | str) -> Column:
    """A number of digits, or of Chinese numerals: cut behind each unit, a part counts its last digit (one, if it has none) times its unit."""
    units = "".join(K.NUMERAL_UNITS)
    parts = F.regexp_extract_all(_col(text), F.lit(f"[^{units}]*[{units}]|[^{units}]+$"), F.lit(0))

    def value(part: Column) -> Column:
        size = F.try_element_at(F.create_map(*[F.lit(x) for pair in K.NUMERAL_UNITS.items() for x in pair]), F.substring(part, -1, 1))
        digit = F.greatest(F.instr(F.lit(K.NUMERALS), F.regexp_extract(part, f"([{K.NUMERALS}])[^{K.NUMERALS}]*$", 1)) - 1, F.lit(0))
        return F.when(size.isNull(), digit).otherwise(F.greatest(digit, F.lit(1)) * size)

    counted = F.aggregate(F.transform(parts, value), F.lit(0), lambda a, b: a + b)
    return F.when(_col(text).rlike(r"^\d+$"), _col(text).try_cast("int")).otherwise(counted)


def normalized_query(nfkc: Column | str) -> Column:
    """A query in NFKC with ASCII lower-cased and punctuation in one form; its words are set apart by one space, or none where marks need none."""
    lower = F.translate(_col(nfkc), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(F.translate(lower, *K.QUERY_PUNCTUATION), r"\s+"), lambda w: w != "")
    ahead, behind = list(K.TIGHT_MARKS + K.CLOSING_MARKS), list(K.OPENING_MARKS)

    def join(done: Column, word: Column) -> Column:
        close = (done == "") | F.substring(word, 1, 1).isin(ahead) | F.substring(done, -1, 1).isin(behind)
        return F.concat(done, F.when(close, F.lit("")).otherwise(F.lit(" ")), word)

    return F.aggregate(words, F.lit(""), join)


def article_terms(query: Column | str) -> Column:
    """Articles that a normalised query names, as 第<number>条."""
    numbers = F.transform(F.regexp_extract_all(_col(query), F.lit(K.ARTICLE_PATTERN), F.lit(1)), cn_number)
    return F.array_distinct(F.transform(F.filter(numbers, lambda n: n > 0), lambda n: F.format_string("第%d条", n)))


def title_terms(query: Column | str) -> Column:
    """What a normalised query holds besides articles, question words and linking words; the whole query if that is nothing."""
    between = "|".join((K.ARTICLE_PATTERN, *K.QUESTION_WORDS, f"[{K.LINKING_WORDS}]", r"\s+"))
    found = F.filter(F.split(_col(query), between), lambda t: t != "")
    return F.when((F.size(found) > 0) | (_col(query) == ""), found).otherwise(F.array(_col(query)))


def neighbor_heuristic(query: Column | str) -> Column:
    """How many neighbours a question's wording asks for; 1 if it doesn't say."""
    found = None
    for value, words in K.NEIGHBOR_WORDS:
        hit = F.lower(_col(query)).rlike("|".join(words.split()))
        found = F.when(hit, value) if found is None else found.when(hit, value)
    return found.otherwise(1)


def tolerant_pattern(literal: str) -> str:
    """A Java regex for literal in which half- and full-width marks match each other."""
    forms = {a: f"[{a}{b}]" for pair in K.PUNCTUATION_PAIRS for a, b in (pair, pair[::-1])}
    return "".join(forms.get(c) or (c if c.isalnum() or c.isspace() else "\\" + c if ord(c) < 128 else c) for c in literal)


def decayed(weight: Column | str, last_used: Column | str, now: Column, half_life_days: float = K.HALF_LIFE_DAYS) -> Column:
    """weight after exponential decay; null where it falls to 0.01 or less."""
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(_col(last_used).cast("timestamp"))) / F.lit(86_400_000_000.0)
    left = _col(weight) * F.exp(-F.lit(0.6931471805599453) * F.greatest(days, F.lit(0.0)) / half_life_days)
    return F.when(left > K.WEIGHT_MIN, left)


def inferred_headings(text: Column | str) -> Column:
    """Plain text to Markdown: underlined lines, chapters, numbered and short lines alone between blanks become headings.

    A line of === or --- makes the last line that isn't an underline a heading of level 1 or 2.
    """
    lines = F.transform(F.split(F.coalesce(_col(text), F.lit("")), r"\r\n|\r|\n"), lambda x: F.rtrim(x))
    mark = lambda line: F.when(F.trim(line).rlike("^={3,}$"), "# ").when(F.trim(line).rlike("^-{3,}$"), "## ")

    def underlined(all_: Column) -> Column:
        """Lines without underlines, those ahead of underlines as headings; each line is looked at once."""
        numbers = F.sequence(F.lit(0), F.size(all_) - 1)
        stays = F.filter(numbers, lambda i: (i == 0) | mark(F.get(all_, i)).isNull())

        def line(kept: Column, k: Column) -> Column:
            at, after = F.get(kept, k), F.coalesce(F.get(kept, k + 1), F.size(all_))
            first = F.get(all_, at)
            bare = F.when((F.trim(first) == "") & mark(first).isNull(), F.lit("")).otherwise(first)
            marks = F.slice(all_, at + 2, after - at - 1)
            return F.when(after == at + 1, bare).otherwise(F.aggregate(marks, bare, lambda done, x: F.concat(mark(x), F.trim(done))))

        return _let(stays, lambda kept: F.transform(F.sequence(F.lit(0), F.size(kept) - 1), lambda k: line(kept, k)))

    def head(under: Column, line: Column, i: Column) -> Column:
        bare = F.trim(line)
        alone = ((i == 0) | (F.trim(F.get(under, i - 1)) == "")) & ((i == F.size(under) - 1) | (F.trim(F.get(under, i + 1)) == ""))
        number = F.regexp_extract(bare, K.NUMBERED_PATTERN, 1)
        depth = F.least(F.size(F.split(number, r"\.")), F.lit(6))
        item = bare.rlike(K.ITEM_PATTERN)
        chapter = bare.rlike("|".join(f"(?:{p})" for p in K.CHAPTER_PATTERNS))
        return (
            F.when((bare == "") | bare.startswith("#") | ~alone, line)
            .when(chapter, F.concat(F.lit("# "), bare))
            .when(number != "", F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), bare))
            .when((F.char_length(bare) < K.SHORT_HEADING) & ~item, F.concat(F.lit("### "), bare))
            .otherwise(line)
        )

    # Each list is computed once and then named: a column that lambdas name again is computed again for every line.
    headed = _let(_let(lines, underlined), lambda under: F.transform(under, lambda line, i: head(under, line, i)))
    return F.concat(F.regexp_replace(F.array_join(headed, "\n"), r"\n$", ""), F.lit("\n"))
