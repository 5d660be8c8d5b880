"""Many questions against a corpus at once, by an inverted index; scores and order are those of retrieval.search.

A chunk can only be among a question's best k if it beats the k-th best score known so far. The question's tokens are put in
order, rarest first. What a chunk gains from the tokens at the end of that order alone is bounded by their number, so chunks
that hold none of the first tokens need not be looked at as soon as that bound is below the k-th best score:

1. Posting lists of the first, rarest tokens give some chunks; their exact scores give a lower bound of the k-th best score.
2. The bound says how many of a question's tokens may be left out. The lists of all others give every chunk that can matter;
   the exact best k are among them, ties included.

A token's list is split into parts of PART chunks, so a token of most chunks is joined by many tasks; common tokens at the end
of a question's order are never joined at all. A chunk whose alias or title stands in the question is a candidate by itself:
such names are matched by the substrings of the question that are as long as some name.

Defined results: a null or blank question has no hits; chunks that repeat an id are chunks of their own; a question's id may
repeat only with the same text; chunks that score 0 are no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared
from .retrieval import tokens

PART = 20_000
#: How many chunks the first round looks at for each question, as a multiple of k; it changes the work and not the result.
FIRST_LOOK = 16


def _points(held: Column, asked: Column) -> Column:
    return F.coalesce(F.try_divide(held.cast("double"), F.sqrt(asked.cast("double"))), F.lit(0.0))


def index(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The corpus with its row numbers and tokens, and the postings (token, part, row) with each token's parts and size."""
    own = tokens(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    names = F.filter(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("title")), lambda n: n.isNotNull() & (n != ""))
    rows = shared.kept(corpus.select(F.monotonically_increasing_id().alias("row"), "id", "title", "aliases", F.lower(F.array_join(names, "\n")).alias("names"), own.alias("tokens")), "index-chunks")
    lists = rows.select(F.explode("tokens").alias("token"), "row")
    sizes = lists.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return rows, shared.kept(sizes, "index-sizes")


def _scored(pairs: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Exact scores of (q, row) pairs, as the retrieval of a single question gives them."""
    both = pairs.join(asked.select("q", "low", F.col("tokens").alias("asked")), "q").join(rows, "row")
    named = F.size(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: (a != "") & F.contains(F.col("low"), F.lower(a)))) * 2.0
    titled = F.when((F.length("title") > 0) & F.contains(F.col("low"), F.lower("title")), 1.5).otherwise(0.0)
    score = F.round(named + titled + _points(F.size(F.array_intersect("asked", "tokens")), F.size("asked")), 4)
    return both.select("q", "row", "id", score.alias("score")).where("score > 0")


def _chunks_of(lists: DataFrame, wanted: DataFrame) -> DataFrame:
    """(q, row) of the chunks in the lists of (q, token, parts): each list's part meets its own copy of the question."""
    each = wanted.select("q", "token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return each.join(lists, ["token", "part"]).select("q", "row").distinct()


def search_all(corpus: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """(q, rank, id, score): the k best chunks of every question (q, question), ties by id.

    corpus: id, title, text, aliases, of which title and aliases may be empty.
    """
    rows, sizes = index(corpus)
    text = F.trim(F.coalesce("question", F.lit("")))
    asked = shared.kept(questions.select("q", F.lower(text).alias("low"), tokens(text).alias("tokens")).where("low <> ''").dropDuplicates(["q"]), "index-questions")
    terms = asked.select("q", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(sizes, "token")
    order = Window.partitionBy("q").orderBy("df", "token")
    parts = F.ceil(F.col("df") / PART).cast("int").alias("parts")
    known = F.count(F.lit(1)).over(Window.partitionBy("q"))
    terms = terms.select("q", "token", "n", "df", parts, F.row_number().over(order).alias("place"), F.sum("df").over(order).alias("looked"), known.alias("known"))
    terms = shared.kept(terms, "index-terms")
    used = terms.select("token", "parts").distinct()  # the lists of tokens that no question holds aren't built
    lists = rows.select(F.explode("tokens").alias("token"), "row").join(used, "token")
    lists = shared.kept(lists.select("token", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"), "row"), "index-lists")

    lengths = [r[0] for r in rows.select(F.explode(F.split("names", "\n")).alias("name")).select(F.length("name").alias("n")).where("n > 0").distinct().collect()]  # lengths of names
    by_name = None
    if lengths:
        names = rows.select("row", F.explode(F.split("names", "\n")).alias("name")).where("name <> ''")
        starts = asked.select("q", "low", F.explode(F.array(*[F.lit(n) for n in sorted(lengths)])).alias("n")).where(F.length("low") >= F.col("n"))
        cuts = F.transform(F.sequence(F.lit(1), F.length("low") - F.col("n") + 1), lambda i: F.substring(F.col("low"), i, F.col("n")))
        by_name = starts.select("q", F.explode(F.array_distinct(cuts)).alias("name")).join(names, "name").select("q", "row").distinct()

    first = _chunks_of(lists, terms.where((F.col("place") == 1) | (F.col("looked") <= FIRST_LOOK * k)))
    first = first if by_name is None else first.unionByName(by_name).distinct()
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id", "row")
    least = _scored(first, rows, asked).withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("q", F.col("score").alias("least"))
    # the most tokens that may be left out: those that alone can't give the k-th best score
    root = F.sqrt(F.col("n").cast("double"))
    most = F.greatest(F.ceil(F.coalesce("least", F.lit(0.0)) * root).cast("int") - 1, F.lit(0))
    most = F.when((most > 0) & (F.round(_points(most, F.col("n")), 4) >= F.col("least")), most - 1).otherwise(most)
    needed = terms.join(least, "q", "left").where(F.col("place") <= F.col("known") - most)
    second = _chunks_of(lists, needed)
    second = (second if by_name is None else second.unionByName(by_name)).unionByName(first).distinct()
    ranked = _scored(second, rows, asked).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("q", "rank", "id", "score")
