"""Which messages are worth extracting, and which stored rows are noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsift.functions.text import any_sql, has_any, let
from leadsift.rules import (
    DEFAULT_RULES,
    NOISE_MARKERS,
    SENDER_MARKERS,
    SKIP,
    TEXT_MARKERS,
    RulePack,
)
from leadsift.sources.shared import shared_folder


def is_relevant(
    rules: RulePack = DEFAULT_RULES,
    subject: str = "subject", sender: str = "sender", body: str = "body",
) -> Column:
    """Noise words lose; then allowed senders, sender markers and text markers win.

    The texts are bound once by a lambda: a filter does not share sub-expressions.
    """
    scanned = f"coalesce({body}, '')"
    if rules.scan_chars is not None:
        scanned = f"left({scanned}, {rules.scan_chars})"
    text = f"concat(lower(coalesce({subject}, '')), '\\n', lower({scanned}))"
    known = any_sql("x.who", (*rules.sender_tokens(), *SENDER_MARKERS))
    test = f"NOT ({any_sql('x.t', NOISE_MARKERS)}) AND ({known} OR {any_sql('x.t', TEXT_MARKERS)})"
    texts = f"named_struct('t', {text}, 'who', lower(coalesce({sender}, '')))"
    return F.expr(f"get(transform(array({texts}), x -> {test}), 0)")


def relevant_messages(messages: DataFrame, rules: RulePack = DEFAULT_RULES) -> DataFrame:
    return messages.filter(is_relevant(rules))


def headers_first(
    headers: DataFrame, bodies: DataFrame, rules: RulePack = DEFAULT_RULES
) -> DataFrame:
    """Drop messages on their headers alone, then fetch bodies only for the rest.

    ``headers`` and ``bodies`` share ``source_id``. A message whose headers look
    irrelevant is dropped whatever its body says.
    """
    kept = headers.filter(is_relevant(rules, body="''"))
    return relevant_messages(kept.join(bodies, "source_id"), rules)


#: Characters of a piece in the index of long lists; tokens of twice as many are filed under pieces of that width.
GRAM = 4
#: Hash slots in which pieces are counted.
SLOTS = 1 << 14


def _grams(text: Column, width: int) -> Column:
    """Distinct pieces of ``width`` characters."""
    starts = F.sequence(F.lit(1), F.length(text) - width + 1)
    return F.when(F.length(text) >= width, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(width)))))


def _slot_rows(piece: Column, counts: Column) -> Column:
    return F.get(counts, F.pmod(F.xxhash64(piece), F.lit(SLOTS)).cast("int"))


def _slot_counts(pieces: DataFrame) -> Column:
    """Rows in each hash slot of ``piece`` as a constant array; its size is the same for any table."""
    slot = F.pmod(F.xxhash64("piece"), F.lit(SLOTS)).cast("int")
    found = {r["slot"]: r["count"] for r in pieces.groupBy(slot.alias("slot")).count().collect()}
    return F.split(F.lit(",".join(str(found.get(i, 0)) for i in range(SLOTS))), ",").cast("array<bigint>")


def _rarest(token: Column, size: int, counts: Column) -> Column:
    """(n, piece) of the piece whose slot has the fewest rows."""
    places = F.transform(F.sequence(F.lit(1), F.length(token) - size + 1), lambda i: F.substring(token, i, F.lit(size)))
    return F.array_min(F.transform(places, lambda g: F.struct(_slot_rows(g, counts).alias("n"), g.alias("piece"))))


def contained_tokens(texts: DataFrame, tokens: DataFrame, width: int = GRAM) -> DataFrame:
    """(text, token) for each token that a text contains; ``texts(text)``, ``tokens(token)`` distinct.

    An inverted index: a token is filed under that of its pieces whose hash slot the fewest texts
    have, and meets only the texts with this piece; the match itself is tested. The slot counts are
    a constant, so that a token finds its piece in its own row and its pieces are never shuffled.
    Tokens of twice the width have pieces of twice the width. Tokens shorter than a piece are pieces
    of their own length, looked up as a whole; pieces of texts in slots without a token stay out of
    the join. A piece that many texts share and many tokens are filed under is an ordinary skewed
    key of an equi join, which adaptive execution splits; no nested loop is planned. Blank tokens
    match nothing.
    """
    length = F.length("token")
    matched = texts.sparkSession.createDataFrame([], "text string, token string")
    for size, listed in ((2 * width, length >= 2 * width), (width, (length >= width) & (length < 2 * width))):
        long = tokens.where(listed)
        if long.isEmpty():
            continue
        pieces = texts.select("text", F.explode(_grams(F.col("text"), size)).alias("piece"))
        counts = _slot_counts(pieces)
        rarest = _rarest(F.col("token"), size, counts)
        # A token with a piece in a slot that no text has cannot match.
        filed = long.select("token", rarest.alias("rarest")).where("rarest.n > 0").select("token", "rarest.piece")
        matched = matched.unionByName(
            pieces.join(filed, "piece").where(F.col("text").contains(F.col("token"))).select("text", "token")
        )
    short = tokens.where((length < width) & (length > 0))
    counts = None if short.isEmpty() else _slot_counts(short.select(F.col("token").alias("piece")))
    for size in range(1, width) if counts is not None else ():
        whole = texts.select("text", F.explode(_grams(F.col("text"), size)).alias("token"))
        whole = whole.where(_slot_rows(F.col("token"), counts) > 0)
        matched = matched.unionByName(whole.join(short.where(length == size), "token").select("text", "token"))
    return matched


def allowed_by_list(messages: DataFrame, allowlist: DataFrame, max_bytes: int = 256 << 10) -> DataFrame:
    """Messages whose sender contains a listed token; ``allowlist(token STRING)``.

    A list within ``max_bytes`` is broadcast and tested token by token. A longer one is written to
    the shared folder once and matched through ``contained_tokens``, over the distinct senders.
    """
    tokens = allowlist.select(F.lower(F.trim("token")).alias("token")).filter("token <> ''").distinct()
    low = F.lower("sender")
    if max_bytes > 0:
        size = tokens.agg(F.sum(F.octet_length("token")).alias("n")).first()["n"] or 0
        if size <= max_bytes:
            return messages.join(F.broadcast(tokens), low.contains(F.col("token")), "left_semi")
    spark = messages.sparkSession
    folder = shared_folder(spark, "tokens")
    tokens.write.parquet(folder)
    senders = messages.select(low.alias("text")).where("text IS NOT NULL").distinct()
    matched = contained_tokens(senders, spark.read.schema("token string").parquet(folder)).select(F.col("text").alias("_sender")).distinct()
    return messages.join(matched, low == F.col("_sender"), "left_semi")


def is_noise_row() -> Column:
    """Stored Skip rows whose company and title text carries a noise marker."""
    text = F.lower(F.concat_ws(" ", "company", "title"))
    return (F.col("category") == SKIP) & let(text, lambda t: has_any(t, NOISE_MARKERS))
