"""Personal data: fixed formats, and bootstrapped contextual extraction of what they miss.

Fixed formats (email, ip, card, phone) are matched and checked as they stand; these
entities are the seeds. Every identifier-like token of the corpus is an instance, and the
word before it, whatever the token looks like, is its pattern. Words are what white space
separates, and end behind ":" and "=", so "ip:" is one in "ip:10.0.0.1". The graph of
patterns and instances, with counts, is scored in rounds:

* a pattern's confidence for a kind is the scores of its matches (seeds 1), divided by the
  number of times its word occurs at all, whatever follows, so common words are no patterns;
  it is good with CONFIDENCE and MIN_SEEDS different seeds;
* an unseen instance scores the confidence of the good patterns before it, averaged over all
  its occurrences. With CONFIDENCE it is discovered: a seed of the next round, which may make
  further patterns good, in whose place further identifiers are found.

After ROUNDS rounds, unseen identifiers of LEAST characters or more behind a good pattern
become spans of its kind.

Everything runs as SQL functions, and all scores are joined as tables: counts are
pre-aggregated, and joins read written tables, so a frequent word splits over tasks.

Defined results: a null text is an empty one; an empty table gives an empty result;
repeated rows each keep their row; without seeds nothing is discovered. Rows are told
apart by doc_id (null included) and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ixpanel.llm.common import cut, prepare, table, text_or_empty
from ixpanel.llm.spans import digest, labelled, with_spans, written

# Possessive groups and look-behinds keep the time linear; the matches are those of the plain forms.
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
KINDS = ["email", "ip", "card", "phone"]
# Identifier-like: a phone number, a number with an area code in brackets, a long number, or a word
# with a digit or an at sign.
TOKEN = (rf"{PHONE}|\([0-9]{{2,5}}\)\x20?[0-9]++(?:[\x20.-][0-9]++)*+|{CARD}|"
         r"(?<![A-Za-z0-9@._%+/-])[A-Za-z._%+/-]*+[0-9@](?:[._%+/-]*+[A-Za-z0-9@])*+")
WORD_ENDS = r"(?<=[:=])|\s+"
ROUNDS = 3
CONFIDENCE = 0.5
MIN_SEEDS = 3
LEAST = 4                  # characters of a discovered identifier
LONGEST_WORD = 40          # longer words are no patterns
MASKS = {k: f"<{k.upper()}>" for k in KINDS}


def _digits(c: str) -> str:
    return f"regexp_replace({c}, '[^0-9]', '')"


_VALID = {
    "email": "true",
    "ip": f"s.hit rlike '^{BYTE}(?:[.]{BYTE}){{3}}$'",
    "card": f"length({_digits('s.hit')}) between 14 and 19 and luhn_check({_digits('s.hit')})",
    "phone": f"length({_digits('s.hit')}) between 10 and 15",
}


def with_base(df: DataFrame) -> DataFrame:
    """Adds the array columns email, ip, card and phone: the spans of the fixed formats in ``text``."""
    for kind, pattern in zip(KINDS, (EMAIL, IP, CARD, PHONE)):
        df = with_spans(df, kind, pattern).withColumn(kind, F.expr(f"filter({kind}, s -> {_VALID[kind]})"))
    return df


def row_key() -> Column:
    """Tells rows apart: equal for rows with equal doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("string"), F.col("doc_id").isNull(), "text", F.length("text"))


def occurrences(docs: DataFrame) -> DataFrame:
    """Identifier-like tokens of ``docs`` (key, text) behind a word: key, start, end, word (lower
    case), instance (lower case) and kind (null: unseen)."""
    def whole(kind, pattern):
        valid = _VALID[kind].replace("s.hit", "hit")
        return f"when hit rlike '^(?:{pattern})$' and {valid} then '{kind}'".replace("\\", "\\\\")

    kinds = "case " + " ".join(whole(k, p) for k, p in zip(KINDS, (EMAIL, IP, CARD, PHONE))) + " end"
    # inline_outer: Spark would put a size filter below inline, and with it all that makes the array.
    found = with_spans(docs, "t", TOKEN, gaps=True).select(
        "key", F.expr("inline_outer(transform(t, (s, i) -> named_struct('start', s.start, 'end', s.end, 'hit', s.hit, "
                      # Between two tokens a word begins behind white space, ":" or "=" alone.
                      f"'before', concat(if(i = 0, ' ', ''), right(t_gaps[i], {LONGEST_WORD + 2})))))"))
    return found.select(
        "key", "start", "end", F.expr(kinds).alias("kind"), F.lower("hit").alias("instance"),
        F.lower(F.regexp_extract("before", r"[\s:=]([^\s:=]*[:=]|[^\s:=]+)\s?$", 1)).alias("word")).where(
        f"start is not null and length(word) between 1 and {LONGEST_WORD}")


def word_counts(docs: DataFrame, words: DataFrame) -> DataFrame:
    """How often each of ``words`` (word) occurs in all texts."""
    every = docs.select(F.explode(F.split(F.lower("text"), WORD_ENDS)).alias("word")).groupBy("word").agg(
        F.count("*").alias("total"))
    return words.select("word").distinct().join(every, "word")


def patterns(seen: DataFrame, docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE,
             min_seeds: int = MIN_SEEDS) -> DataFrame:
    """The good patterns of ``seen`` (the occurrences): word, found (kind), confidence."""
    edges = cut(seen.groupBy("word", "instance").agg(F.count("*").alias("n"), F.max("kind").alias("kind")))
    # A word with fewer instances than a pattern has seeds never is one; nor does it change an
    # instance's score but by its count.
    enough = edges.groupBy("word").agg(F.count("*").alias("m")).where(F.col("m") >= min_seeds)
    totals = cut(word_counts(docs, enough))
    uses = cut(edges.where("kind is null").groupBy("instance").agg(F.sum("n").alias("uses")))
    edges = cut(edges.join(totals.select("word"), "word", "left_semi"))
    score = {k: F.when(F.col("kind").isNotNull(), (F.col("kind") == k).cast("double")) for k in KINDS}
    best = F.greatest(*(F.col(k) for k in KINDS))
    found = None
    for r in range(rounds):
        known = edges if found is None else edges.join(found, "instance", "left")
        of = {k: F.coalesce(score[k], F.lit(0.0) if found is None else F.col(f"u_{k}"), F.lit(0.0)) for k in KINDS}
        seed = F.col("kind").isNotNull() if found is None else F.col("kind").isNotNull() | F.col("u_email").isNotNull()
        per = known.groupBy("word").agg(F.count_if(seed).alias("seeds"), *(
            F.sum(F.col("n") * of[k]).alias(k) for k in KINDS))
        per = per.where(F.col("seeds") >= min_seeds).join(totals, "word").select(
            "word", *(F.least(F.col(k) / F.col("total"), F.lit(1.0)).alias(k) for k in KINDS))
        good = cut(per.where(best >= confidence))
        if r + 1 < rounds:
            scored = edges.where("kind is null").join(good, "word").groupBy("instance").agg(
                *(F.sum(F.col("n") * F.col(k)).alias(k) for k in KINDS)).join(uses, "instance")
            scored = scored.select("instance", *((F.col(k) / F.col("uses")).alias(f"u_{k}") for k in KINDS))
            found = cut(scored.where(F.greatest(*(F.col(f"u_{k}") for k in KINDS)) >= confidence))
    return good.select("word", F.coalesce(*(F.when(F.col(k) == best, F.lit(k)) for k in KINDS)).alias("found"),
                       best.alias("confidence"))


def discovered(docs: DataFrame, **how) -> DataFrame:
    """``docs`` (key, text). Returns key and extra: the discovered spans of rows that have any."""
    seen = cut(occurrences(docs))
    good = cut(patterns(seen, docs, **how))
    new = seen.where(f"kind is null and end - start >= {LEAST}").join(good, "word")
    return new.groupBy("key").agg(F.collect_set(F.struct("start", "end", "found")).alias("extra"))


def find(docs: DataFrame, **how) -> DataFrame:
    """``docs`` (doc_id, text and other columns, but none named base or every) with base (spans of the fixed formats, as start,
    rank, kind, end) and every (those and the discovered ones, kind ctx_ and its kind). A null text
    is an empty one, in its own column as well."""
    prepare(docs.sparkSession)
    rows = docs.withColumn("text", text_or_empty())
    names = [c for c in docs.columns]
    inner = rows.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), "text", row_key().alias("key"))
    new = cut(discovered(inner.select("key", "text"), **how))
    based = with_base(inner).withColumn("base", labelled([(k, k) for k in KINDS])).drop(*KINDS)
    extra = ("coalesce(transform(extra, s -> named_struct('start', s.start, 'rank', 4 + array_position("
             f"array({', '.join(map(repr, KINDS))}), s.found), 'kind', concat('ctx_', s.found), 'end', s.end)), "
             "cast(array() as array<struct<start: bigint, rank: bigint, kind: string, end: bigint>>))")
    based = based.withColumn("base", F.expr(
        "cast(base as array<struct<start: bigint, rank: bigint, kind: string, end: bigint>>)"))
    return based.join(new, "key", "left").select(
        "row.*", "base", F.sort_array(F.concat("base", F.expr(extra))).alias("every"))


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def redacted(text: str = "text", spans: str = "every", block: int = 64) -> Column:
    """The text with its spans replaced by their kind in angle brackets; overlapping ones as one, by
    the kind of the first.

    Spans come sorted, and are worked on in blocks, each with its own part of the text: from where
    the spans before the block end to where those of the block do. So the work is linear in the
    spans, but for one short list of the blocks' ends."""
    chunks = F.transform(F.sequence(F.lit(1), F.size(spans), F.lit(block)), lambda at: F.slice(spans, at, F.lit(block)))

    def joined(chunk, begin, part):
        start = F.struct(begin.alias("reach"), F.array().cast("array<string>").alias("out"))
        mark = lambda s: F.concat(F.lit("<"), F.upper(F.replace(s["kind"], F.lit("ctx_"), F.lit(""))), F.lit(">"))
        plain = lambda acc, s: part.substr((acc["reach"] - begin + 1).cast("int"), (s["start"] - acc["reach"]).cast("int"))
        return F.aggregate(chunk, start, lambda acc, s: F.struct(
            F.greatest(acc["reach"], s["end"]).alias("reach"),
            F.when(s["start"] >= acc["reach"], F.concat(acc["out"], F.array(F.concat(plain(acc, s), mark(s)))))
            .otherwise(acc["out"]).alias("out")), lambda acc: F.array_join(acc["out"], ""))

    def whole(parts, ends):
        def one(chunk, k):
            begin, end = F.get(ends, k), F.get(ends, k + 1)
            return _let(F.substring(text, (begin + 1).cast("int"), (end - begin).cast("int")),
                        lambda part: joined(chunk, begin, part))
        return F.concat(F.array_join(F.transform(parts, one), ""),
                        F.substring(text, (F.element_at(ends, -1) + 1).cast("int"), F.length(text)))

    def ends(parts):        # where the spans up to each block end, 0 first
        tops = F.transform(parts, lambda c: F.array_max(F.transform(c, lambda s: s["end"])))
        return F.aggregate(tops, F.array(F.lit(0).cast("long")), lambda acc, t: F.concat(
            acc, F.array(F.greatest(F.element_at(acc, -1), t))))

    return F.when(F.size(spans) > 0, _let(chunks, lambda parts: _let(ends(parts), lambda e: whole(parts, e)))) \
            .otherwise(F.col(f"`{text}`"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    count = lambda k: F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}")
    return find(docs).select("doc_id", *(count(k) for k in KINDS), digest(written("base")).alias("base_sha256"),
                             written("every").alias("spans"))
