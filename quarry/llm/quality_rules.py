"""Line-first cleaning, in SQL expressions only.

Every line meets three rules: punctuation (runs of symbols, or a long line without any end of sentence), navigation
(separators between the words of a menu) and boilerplate (a short line with a stock phrase). Lines that fail go; a
document that loses more than half of its word characters is rejected, as is one that fails the base limits.

Null text has no words and fails the base limits; empty text likewise. A text without line breaks is one line. Equal
rows get equal results, and no row depends on another: one narrow pass, no shuffle. Other columns are carried along
inside a struct, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import computed, words

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
RUNS = r"[#*$%&|<>!?~^=_+]{2,}"
MARKS = "|>»›•·/\\"
SEPARATORS = r"(?:^|[\x20\x09-\x0D])[|>»›•·/\\](?=[\x20\x09-\x0D]|$)"
ENDS = r"[.!?:;,…。！？।؟]"
BOILERPLATE = (
    r"(?i)all rights reserved|terms of (?:use|service)|privacy policy|cookie (?:policy|settings)|accept (?:all )?cookies"
    r"|powered by|click here|read more|subscribe (?:to|now)|sign (?:up|in) (?:to|for|now)|javascript (?:is|must be)"
    r"|licensed under|released under|copyright (?:\(c\)|©|[0-9]{4})|skip to (?:main )?content|lorem ipsum"
    r"|alle rechte vorbehalten|datenschutzerkl|nutzungsbedingungen|cookies (?:akzeptieren|zulassen)|hier klicken|weiterlesen"
    r"|tous droits r.serv.s|politique de confidentialit|mentions l.gales|accepter (?:les )?cookies|cliquez ici|lire la suite"
    r"|todos los derechos reservados|pol.tica de privacidad|aviso legal|aceptar (?:las )?cookies|haga clic aqu|leer m.s"
)


def _size(c: Column) -> Column:
    return F.size(c).cast("long")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, "")).cast("long")


def base_metrics(text: Column) -> dict[str, Column]:
    """Counts over a whole text by name; text must not be null."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_symbols": F.length(text) - _without(text, SYMBOLS),
        "n_dup_lines": _size(lines) - _size(F.array_distinct(lines)),
    }


def repeated_starts(trigrams: Column) -> Column:
    """Where the three-word windows start that the text has twice or more, ascending.

    trigrams: sorted array of (h, i), h the window's hash and i its place; neighbours with equal h are repeats.
    """
    again = F.filter(
        trigrams,
        lambda s, j: F.coalesce(F.get(trigrams, j - 1)["h"] == s["h"], F.lit(False))
        | F.coalesce(F.get(trigrams, j + 1)["h"] == s["h"], F.lit(False)),
    )
    return F.sort_array(F.transform(again, lambda s: s["i"]))


def covered(starts: Column) -> Column:
    """How many words those windows cover: three each, less what the next start covers as well.

    starts must be a plain column: an expression would be computed again for every element.
    """
    steps = F.transform(starts, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1), p + 3) - p))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)


def windows(tokens: Column) -> Column:
    n = F.size(tokens)
    return F.sort_array(
        F.when(
            n >= 3,
            F.transform(
                F.sequence(F.lit(0), n - 3),
                lambda i: F.struct(
                    F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)).alias("h"), i.alias("i")
                ),
            ),
        ).otherwise(F.expr("cast(array() as array<struct<h:bigint,i:int>>)"))
    )


def line_fails(line: Column) -> Column:
    """Whether a line breaks one of the three rules. Each rule begins with what is cheap and rarely true: in a lambda an
    expression is computed wherever it is mentioned and reached."""
    n, chars = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")), F.length(line)
    marks, separators = F.regexp_count(line, F.lit(RUNS)), F.regexp_count(line, F.lit(SEPARATORS))
    unended = (chars >= 119) & ~line.rlike(ENDS) & (n >= 60)  # 60 words have 59 blanks between them
    punctuation = ((marks >= 3) & (marks * 10 >= n * 3)) | unended
    parted = reduce(Column.__or__, [F.contains(line, F.lit(c)) for c in MARKS])
    navigation = parted & (separators >= 2) & (separators * 4 >= n)
    boilerplate = ((chars <= 60) | (n <= 30)) & line.rlike(BOILERPLATE)
    return punctuation | navigation | boilerplate


def assess(docs: DataFrame, text_col: str = "text", min_words: int = 50, max_repeat: int = 50, max_loss: int = 50) -> DataFrame:
    """One row per input row: row (all input columns), clean_text, the counts, base_failed and kept.

    max_repeat and max_loss are per cent. clean_text is what remains of the text after the line rules.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("t"))
    kept_lines = F.filter(F.split(F.col("t"), "\n", -1), lambda x: ~line_fails(x))
    step = base.select("row", "t", words(F.col("t")).alias("w"), F.array_join(kept_lines, "\n").alias("clean_text"))
    step = step.select("row", "t", "w", "clean_text", windows(F.col("w")).alias("g"))
    step = step.select("row", "t", "w", "clean_text", repeated_starts(F.col("g")).alias("starts"))
    step = step.select(
        "row",
        "clean_text",
        _size(F.col("w")).alias("n_words"),
        covered(F.col("starts")).alias("n_repeat_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        *[c.cast("long").alias(k) for k, c in base_metrics(F.col("t")).items()],
        (F.length("clean_text") == F.length("t")).alias("whole"),
    )
    step = step.withColumn("left_chars", F.when(F.col("whole"), F.col("word_chars")).otherwise(_without(F.col("clean_text"), BLANK))).drop("whole")
    step = step.withColumn(
        "base_failed", (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat)
    )
    lost = F.col("word_chars") - F.col("left_chars")
    return step.withColumn("kept", ~F.col("base_failed") & (lost * 100 <= F.col("word_chars") * max_loss))


def verdicts(docs: DataFrame, **limits: int) -> DataFrame:
    """doc_id, the counts and the verdict of every row of documents."""
    return assess(docs, **limits).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "left_chars", "base_failed", "kept",
    )


def cleaned(docs: DataFrame, **limits: int) -> DataFrame:
    """The documents that are kept, without the lines that failed; n_chars follows the text where there is one."""
    out = computed(assess(docs, **limits).select("row", "clean_text", "kept")).where("kept")
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return out.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
       string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
rw AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i+1, i+2]) AS p FROM r) GROUP BY rid),
l AS (SELECT rid, k, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
       len(regexp_extract_all(l, '{RUNS}')) AS marks,
       len(list_filter(regexp_extract_all(l, '[^\x20\x09-\x0D]+'), lambda x: list_contains(['|', '>', '/', chr(92), chr(187), chr(8250), chr(8226), chr(183)], x))) AS seps
      FROM (SELECT rid, unnest(ls) AS l, unnest(range(len(ls))) AS k FROM w)),
lf AS (SELECT rid, k, l, (marks >= 3 AND marks * 10 >= n * 3)
        OR (n >= 60 AND NOT regexp_matches(l, '[.!?:;,…。！？।؟]'))
        OR (seps >= 2 AND seps * 4 >= n)
        OR (n <= 30 AND regexp_matches(l, '{BOILERPLATE.replace(chr(92) + "u00a9", "©")}')) AS bad FROM l),
c AS (SELECT rid, sum(length(translate(l, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), ''))) FILTER (NOT bad) AS left_chars,
       count(*) FILTER (n > 0) - count(DISTINCT l) FILTER (n > 0) AS dups FROM lf JOIN l USING (rid, k, l) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(w)::BIGINT AS n_words,
        length(translate(t, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), ''))::BIGINT AS word_chars,
        (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
        dups::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words, coalesce(left_chars, 0)::BIGINT AS left_chars
      FROM w JOIN c USING (rid) LEFT JOIN rw USING (rid)),
b AS (SELECT *, (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, left_chars, base_failed,
  NOT base_failed AND (word_chars - left_chars) * 100 <= word_chars * 50 AS kept FROM b
"""
