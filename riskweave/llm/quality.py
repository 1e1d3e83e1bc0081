"""Operator 1, quality rules: line-first cleaning, then document rejection.

Every line is held against three groups of rules and removed if it fails one:

* punctuation: it neither ends with a closing mark nor has a sentence end inside
  (marks of all scripts; scripts that write none, as Thai and Lao, are let off),
  or symbols ``[#*$%&|<>]`` or doubled ``!!`` / ``??`` make up too much of it;
* navigation, by shape: separators (bars, arrows, dots) cut it into items of few
  words each;
* boilerplate: it holds a notice (rights, cookies, scripts, subscriptions) and a
  second sign of one: few words, a year, an address, a copyright sign or a second
  notice. A word of a notice alone, in prose, is no sign. Or it is code by its braces.

A document is rejected if the removed lines held more than ``MAX_LOSS`` of its
word characters, or if the base rules fail it (under 50 words, or over half of
the words inside repeated 3-word windows).

All of it is built-in expressions on one row: no shuffle, no Python. Repeated
windows are found by sorting 40 hash bits and the position of every window as
one number; only windows whose hash bits meet are compared by their words.

Edge cases: null text has no words, no lines and fails the base rules; lines
without a word are dropped at no loss; a text all of whose lines fail is
rejected; repeated rows are each judged; an empty table gives an empty result;
columns besides doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, prepare, words

MIN_WORDS = 50
MAX_LOSS = 0.5          # of the word characters, in removed lines
MAX_SYMBOLS = 0.08      # symbols over characters of a line
SYMBOLS = "#*$%&|<>"
# Sentence ends (Latin, Greek, Armenian, Arabic, Urdu, Indic, Ethiopic, Khmer, Burmese, Tibetan,
# Mongolian, ideographic and full-width marks), those that need no space after them, and closing quotes.
MARKS = (r".!?:;\x{037E}\x{0589}\x{055C}\x{055E}\x{05C3}\x{061B}\x{061F}\x{06D4}\x{0700}-\x{0702}\x{0964}\x{0965}\x{0DF4}"
         r"\x{0F0D}\x{0F0E}\x{104A}\x{104B}\x{1362}-\x{1368}\x{17D4}\x{17D5}\x{1803}\x{1809}\x{2026}\x{203C}-\x{203D}\x{2047}-\x{2049}"
         r"\x{2E2E}")
WIDE = r"\x{3002}\x{FF01}\x{FF0E}\x{FF1A}\x{FF1B}\x{FF1F}\x{FF61}"
CLOSING = r"\"')\]}\x{00BB}\x{2018}\x{2019}\x{201C}\x{201D}\x{203A}\x{3009}\x{300B}\x{300D}\x{300F}\x{3011}\x{FF09}\x{FF3D}\x{FF63}"
ENDS = rf"[{MARKS}{WIDE}][{CLOSING}]*[\x20\x09-\x0D]*$"
INSIDE = rf"[{MARKS}][{CLOSING}]*[\x20\x09-\x0D]|[{WIDE}]"
UNMARKED = r"[\x{0E01}-\x{0E3A}\x{0E81}-\x{0EBD}]"
SHOUTS = 3              # doubled !! or ?? marks of a line, at least
SEPARATOR = r" [|\x{00BB}>\x{203A}\x{2022}\x{00B7}\x{2192}] "
ITEM_WORDS = 4          # words of a menu's item, on average, at most
SHORT_LINE = 200        # characters; notices are short
TAIL = 12               # last characters of a line, among which a closing mark stands
NOTICE = (r"all rights reserved|tous droits r\x{00E9}serv\x{00E9}s|alle rechte vorbehalten|todos los derechos reservados"
          r"|tutti i diritti riservati|\x{0432}\x{0441}\x{0435} \x{043F}\x{0440}\x{0430}\x{0432}\x{0430} \x{0437}\x{0430}\x{0449}\x{0438}\x{0449}\x{0435}\x{043D}\x{044B}"
          r"|\x{7248}\x{6743}\x{6240}\x{6709}|copyright|\x{00A9}|cookie|privacy policy|terms of (?:use|service)|javascript"
          r"|lorem ipsum|click here|subscribe|licen[sc]ed? under|released under the|powered by|log ?in|sign (?:in|up)|back to top")
TWO_NOTICES = rf"(?:{NOTICE}).*(?:{NOTICE})"
SIGN = r"(?i)\x{00A9}|\(c\)|(?:19|20)[0-9][0-9]|https?:|www\.|[a-z0-9]@[a-z0-9]"
NOTICE_WORDS = 8        # a line of so many words at most is short enough for a notice
CODE = r"[{}][^{}]*[{}]|[{};][\x20\x09-\x0D]*$"

_POS = (1 << 24) - 1  # positions fit in the low 24 bits; longer texts compare all windows by words


def _shouts(line: Column) -> Column:
    """Characters in doubled marks."""
    return F.length(line) - F.length(F.replace(F.replace(line, F.lit("!!"), F.lit("")), F.lit("??"), F.lit("")))


def line_fails(line: Column, n_symbols: Column) -> Column:
    """True if a line is to be removed. (Rules that are dear come after cheap ones that decide most lines.)"""
    n_words = F.size(words(line))
    ended = F.right(line, F.lit(TAIL)).rlike(ENDS) | line.rlike(INSIDE) | line.rlike(UNMARKED)
    shouts = (F.contains(line, F.lit("!!")) | F.contains(line, F.lit("??"))) & (_shouts(line) >= 2 * SHOUTS)
    menu = line.rlike(SEPARATOR) & (F.regexp_count(line, F.lit(SEPARATOR)) >= 2) \
        & (n_words <= (ITEM_WORDS + 1) * (F.regexp_count(line, F.lit(SEPARATOR)) + 1))  # separators are words too
    notice = (F.length(line) <= SHORT_LINE) & F.lower(line).rlike(NOTICE) & (
        (n_words <= NOTICE_WORDS) | line.rlike(SIGN) | F.lower(line).rlike(TWO_NOTICES))
    code = (F.contains(line, F.lit("{")) | F.contains(line, F.lit("}"))) & line.rlike(CODE)
    return ~ended | (n_symbols > MAX_SYMBOLS * F.length(line)) | shouts | menu | notice | code


def _word_chars(text: Column) -> Column:
    return F.length(F.array_join(words(text), "")).cast("long")


def _same(a: Column, b: Column) -> Column:
    return F.coalesce((a["a"] == b["a"]) & (a["b"] == b["b"]) & (a["c"] == b["c"]), F.lit(False))


def _repeated(w: Column, n: Column) -> Column:
    """Words of array ``w`` (size ``n``) inside 3-word windows that occur twice or more."""
    at = lambda i: F.get(w, i)
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    mixed = F.sort_array(F.transform(starts, lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))
                                     .bitwiseAND(~_POS).bitwiseOR(i.cast("long"))))
    meet = lambda m: F.filter(m, lambda x, j: F.coalesce(
        (F.shiftright(x, 24) == F.shiftright(F.get(m, j + 1), 24))
        | F.coalesce(F.shiftright(x, 24) == F.shiftright(F.get(m, j - 1), 24), F.lit(False)),
        F.shiftright(x, 24) == F.shiftright(F.get(m, j - 1), 24), F.lit(False)))
    near = F.transform(F.array(mixed), meet)[0]
    near = F.transform(near, lambda x: x.bitwiseAND(_POS).cast("int"))
    near = F.when(n <= _POS, near).otherwise(starts)
    trio = F.array_sort(F.transform(near, lambda p: F.struct(
        at(p).alias("a"), at(p + 1).alias("b"), at(p + 2).alias("c"), p.alias("p"))))
    twice = F.transform(F.array(trio), lambda t: F.filter(
        t, lambda x, j: _same(x, F.get(t, j + 1)) | _same(x, F.get(t, j - 1))))[0]
    found = F.sort_array(F.transform(twice, lambda x: x["p"]))
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    # A window adds the words that the window before it (in order) doesn't cover.
    return F.aggregate(found, zero, lambda acc, p: F.struct(
        p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).cast("long").alias("n")), lambda acc: acc["n"])


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, loss and clean_text (the lines that stay)."""
    prepare(docs.sparkSession)
    body = F.coalesce(F.col("text"), F.lit(""))
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    stripped = lambda s: F.length(s) - F.length(F.translate(s, SYMBOLS, ""))
    rows = src.select("doc_id", words(F.col("text")).alias("w"),
                      F.filter(F.split(body, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    rows = rows.select("doc_id", "w", "lines", F.size("w").alias("n"),
                       F.transform("lines", lambda s: F.struct(s.alias("s"), stripped(s).alias("k"))).alias("parts"))
    # A line with no word is white space only and holds no symbol.
    symbols = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["k"])
    good = F.transform(F.filter("parts", lambda x: ~line_fails(x["s"], x["k"])), lambda x: x["s"])
    rows = rows.select(
        "doc_id", F.col("n").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        symbols.alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("w"), F.col("n")).alias("n_repeat_words"),
        F.array_join(good, "\n").alias("clean_text"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.length(F.regexp_replace("clean_text", WHITE, ""))
    loss = F.when(F.col("word_chars") > 0, 1 - left / F.col("word_chars")).otherwise(F.lit(0.0))
    rows = rows.withColumn("base_failed", base).withColumn("loss", loss)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("loss") <= max_loss))


def _ore(pattern: str) -> str:
    return pattern.replace("'", "''")


_WORDS_SQL = f"len(list_filter(string_split_regex(x, '{WHITE}'), lambda y: y <> ''))"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '{WHITE}'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
      FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
h AS (SELECT r, i FROM g JOIN (SELECT r, a, b, c FROM g GROUP BY ALL HAVING count(*) > 1) USING (r, a, b, c)),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM h) GROUP BY r),
m AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    array_to_string(list_filter(lines, lambda x: NOT (
      NOT (regexp_matches(right(x, {TAIL}), '{_ore(ENDS)}') OR regexp_matches(x, '{_ore(INSIDE)}') OR regexp_matches(x, '{_ore(UNMARKED)}'))
      OR length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) > {MAX_SYMBOLS} * length(x)
      OR length(x) - length(replace(replace(x, '!!', ''), '??', '')) >= {2 * SHOUTS}
      OR (len(regexp_extract_all(x, '{_ore(SEPARATOR)}')) >= 2
          AND {_WORDS_SQL} <= {ITEM_WORDS + 1} * (len(regexp_extract_all(x, '{_ore(SEPARATOR)}')) + 1))
      OR (length(x) <= {SHORT_LINE} AND regexp_matches(lower(x), '{_ore(NOTICE)}') AND ({_WORDS_SQL} <= {NOTICE_WORDS}
          OR regexp_matches(x, '{_ore(SIGN)}') OR regexp_matches(lower(x), '{_ore(TWO_NOTICES)}')))
      OR (regexp_matches(x, '[{{}}]') AND regexp_matches(x, '{_ore(CODE)}'))
    )), chr(10)) AS clean
  FROM w),
s AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    CASE WHEN word_chars > 0 THEN 1 - length(regexp_replace(clean, '{WHITE}', '', 'g')) / word_chars ELSE 0 END AS loss
  FROM m LEFT JOIN c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND loss <= {MAX_LOSS} AS kept
FROM s
"""
