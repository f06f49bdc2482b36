"""The index: stored documents, postings of text and title, forward index, ids and tags.

* Documents and the forward index (document, term, occurrences) lie in the order of ``doc_id``.
* Postings are range partitioned by (term, doc_id): the documents of a term lie side by side, and a
  frequent term spans several parts. A lexicon tells the parts of each term and how many of its
  postings they hold.
* Ids and the lexicon are bucketed, so that finding a few of them reads a few buckets.

Every lookup, by term, by number or by id, opens only the parts that hold what is wanted, however
many keys are given (``sources/pruned.py``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedsift.functions.text import long_enough, space_tokens, whitespace_tokens
from seedsift.plans.bounded import in_list, settle, side_by_side
from seedsift.sources.pruned import Bucketed, Clustered, Reach, reach, read_parts, write_parts


def _terms_of(
    docs: DataFrame, column: str, name: str, max_tokens: int | None, max_word: int | None
) -> DataFrame:
    tokens = F.array_distinct(whitespace_tokens(F.col(column), max_tokens, max_word))
    return docs.select("doc_id", F.explode(tokens).alias(name))


def postings(
    docs: DataFrame,
    text_col: str = "lemmas",
    max_tokens: int | None = None,
    max_word: int | None = None,
) -> DataFrame:
    """(term, doc_id), each pair once."""
    return _terms_of(docs, text_col, "term", max_tokens, max_word).select("term", "doc_id")


def doc_tags(
    docs: DataFrame,
    tags_col: str = "tags",
    max_tokens: int | None = None,
    max_word: int | None = None,
) -> DataFrame:
    """(doc_id, tag), each pair once."""
    return _terms_of(docs, tags_col, "tag", max_tokens, max_word)


def document_frequency(term_postings: DataFrame) -> DataFrame:
    return term_postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def documents_with_tag(tag_table: DataFrame, tag: str) -> DataFrame:
    return tag_table.filter(F.col("tag") == tag).select("doc_id")


def tag_array(tags_col: str = "tags") -> Column:
    """The distinct tags of a document; empty when it has none."""
    return F.coalesce(
        F.array_distinct(whitespace_tokens(F.col(tags_col))), F.array().cast("array<string>")
    )


def forward_rows(docs: DataFrame, text_col: str = "lemmas") -> DataFrame:
    """(..., term, tf): the terms of each document that learning counts, with their occurrences.

    The tokens of a document are sorted within its row and cut into runs, so nothing is shuffled.
    """
    others = [c for c in docs.columns if c != text_col]
    tokens = F.sort_array(F.filter(space_tokens(F.col(text_col)), lambda t: long_enough(t)))
    # One row each: a row of its own keeps the sorted tokens from being sorted again for each use.
    rows = docs.select(*others, F.explode(F.array(tokens)).alias("_t")).filter(F.size("_t") > 0)
    first = F.filter(
        F.sequence(F.lit(0), F.size("_t") - 1),
        lambda i: (i == 0) | (F.get("_t", i) != F.get("_t", i - 1)),
    )
    rows = rows.select(*others, "_t", F.explode(F.array(first)).alias("_at"))
    ends = F.concat(F.slice("_at", F.lit(2), F.size("_at")), F.array(F.size("_t")))
    runs = F.zip_with(
        "_at", ends, lambda i, j: F.struct(F.get("_t", i).alias("term"), (j - i).alias("tf"))
    )
    return rows.select(*others, F.inline(runs))


def documents_by_id(docs: DataFrame, id: str) -> DataFrame:
    return docs.filter(F.col("id") == id)


def spread(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Shuffles a scan that would leave cores idle; a scan with enough splits stays as it is."""
    wanted = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= wanted else docs.repartition(wanted, key)


@dataclass(frozen=True)
class StoredPostings:
    """Range partitioned postings (part, term, doc_id) and their lexicon (bucket, term, part, n)."""

    rows: DataFrame
    lexicon: Bucketed

    @staticmethod
    def write(term_postings: DataFrame, path: str) -> StoredPostings:
        spark = term_postings.sparkSession
        ranged = term_postings.repartitionByRange("term", "doc_id").withColumn(
            "part", F.spark_partition_id()
        )
        write_parts(ranged, f"{path}/postings", "part", ["term", "doc_id"])
        rows = read_parts(spark, f"{path}/postings", ranged.schema, "part")
        n_parts = rows.agg(F.count_distinct("part")).first()[0]
        counted = rows.groupBy("term", "part").agg(F.count(F.lit(1)).alias("n"))
        return StoredPostings(
            rows, Bucketed.write(counted, f"{path}/lexicon", "term", n_parts, ["part"])
        )

    @staticmethod
    def open(spark: SparkSession, path: str) -> StoredPostings:
        rows = read_parts(spark, f"{path}/postings", _POSTINGS, "part")
        return StoredPostings(
            rows, Bucketed.open(spark, f"{path}/lexicon", _LEXICON, "term")
        )

    @property
    def pairs(self) -> DataFrame:
        return self.rows.select("term", "doc_id")

    def reach(self, terms: DataFrame) -> Reach:
        """What holds the postings of some terms, distinct ones in a settled frame."""
        held = settle(self.lexicon.select(terms).select("term", "part"), "term-parts")
        return reach(held, "part", "term")

    def near(self, terms: DataFrame) -> DataFrame:
        """(term, doc_id): all postings of some terms and few besides, for a join with the terms."""
        wanted = settle(terms.select("term").dropna().distinct(), "wanted-terms")
        return self.reach(wanted).of(self.rows, "part", "term").select("term", "doc_id")

    def document_frequency(self) -> DataFrame:
        return self.lexicon.rows.groupBy("term").agg(F.sum("n").alias("df"))


_POSTINGS = T.StructType([T.StructField("term", T.StringType()), T.StructField("doc_id", T.LongType())])
_LEXICON = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("n", T.LongType()),
    ]
)
_IDS = T.StructType([T.StructField("id", T.StringType()), T.StructField("doc_id", T.LongType())])
_FORWARD = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("term", T.StringType()),
        T.StructField("tf", T.IntegerType()),
    ]
)


@dataclass(frozen=True)
class Stored:
    """The tables of an index in files."""

    docs: Clustered
    text: StoredPostings
    title: StoredPostings
    forward: Clustered
    ids: Bucketed


@dataclass(frozen=True)
class Index:
    """The tables of an index; from files, where ``stored`` finds rows by their keys, or computed
    on the fly."""

    docs: DataFrame
    text: DataFrame
    title: DataFrame
    tags: DataFrame
    stored: Stored | None = None

    def postings_of(self, field: str = "lemmas") -> DataFrame:
        return {"lemmas": self.text, "title": self.title}[field]

    def searchable(self, field: str = "lemmas") -> DataFrame | StoredPostings:
        """The postings for scoring: of an index in files, only those of the features are read."""
        if self.stored is None:
            return self.postings_of(field)
        return {"lemmas": self.stored.text, "title": self.stored.title}[field]

    def documents(self, wanted: DataFrame) -> DataFrame:
        """The documents with the given ``doc_id``s, however many."""
        if self.stored is not None:
            return self.stored.docs.select(wanted)
        return self.docs.join(wanted.select("doc_id").dropDuplicates(), "doc_id", "left_semi")

    def term_counts(self, wanted: DataFrame) -> DataFrame:
        """(doc_id, term, tf) of the documents with the given ``doc_id``s."""
        if self.stored is not None:
            return self.stored.forward.select(wanted)
        return forward_rows(self.documents(wanted).select("doc_id", "lemmas"))

    def numbers(self, wanted: DataFrame) -> DataFrame:
        """(id, doc_id) of the documents with the given ids, repeated ids included."""
        ids = wanted.select("id").dropna().dropDuplicates()
        if self.stored is not None:
            return self.stored.ids.select(settle(ids, "wanted-ids"))
        return self.docs.select("id", "doc_id").join(ids, "id", "left_semi")


def index_view(
    docs: DataFrame, max_tokens: int | None = None, max_word: int | None = None
) -> Index:
    """The same tables without writing anything."""
    limits = {"max_tokens": max_tokens, "max_word": max_word}
    return Index(
        docs,
        postings(docs, **limits),
        postings(docs, "title", **limits),
        doc_tags(docs, **limits),
    )


def build_index(
    docs: DataFrame, path: str, max_tokens: int | None = None, max_word: int | None = None
) -> Index:
    """Writes the index, replacing one that is there, and opens it. All tokens of a field are
    indexed unless limits are given.

    The other tables derive from the stored documents, so the document numbers agree even
    when a task is repeated.
    """
    ordered = docs.repartitionByRange("doc_id").withColumn("valid", F.lit(1))
    stored, _ = store_documents(ordered, path)
    return index_stored(stored, path, max_tokens, max_word)


def store_documents(rows: DataFrame, path: str) -> tuple[Clustered, DataFrame]:
    """Documents (``valid`` is 1) and rejected lines (0), written in one go where they are: each
    partition holds neighbouring numbers. Returns both."""
    spark = rows.sparkSession
    rows = rows.withColumn("part", F.spark_partition_id())
    ordered = rows.sortWithinPartitions("valid", "part", "doc_id").write.mode("overwrite")
    ordered.partitionBy("valid", "part").parquet(f"{path}/docs")
    kept = [f for f in rows.schema.fields if f.name not in ("valid", "part")]
    numbers = [T.StructField(name, T.IntegerType()) for name in ("valid", "part")]
    stored = spark.read.schema(T.StructType([*kept, *numbers])).parquet(f"{path}/docs")
    docs = _valid(stored)
    docs.groupBy("part").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).coalesce(
        1
    ).write.mode("overwrite").parquet(f"{path}/bounds")
    return Clustered(docs, spark.read.parquet(f"{path}/bounds")), stored.filter("valid = 0")


def _valid(stored: DataFrame) -> DataFrame:
    rejected = ("valid", "file_path", "line_no", "raw_line")
    return stored.filter("valid = 1").drop(*rejected)


def index_stored(
    stored: Clustered, path: str, max_tokens: int | None = None, max_word: int | None = None
) -> Index:
    """The other tables of an index whose documents are written already."""
    docs = stored.rows.drop("part")
    view = index_view(docs, max_tokens, max_word)
    forward = forward_rows(stored.rows.select("part", "doc_id", "lemmas"))
    n_parts = stored.bounds.count()
    tags = view.tags.sortWithinPartitions("tag", "doc_id").write.mode("overwrite")
    side_by_side(
        docs.sparkSession,
        lambda: StoredPostings.write(view.text, f"{path}/text"),
        lambda: Clustered.write(
            forward.select("doc_id", "term", "tf", "part"), f"{path}/forward", ["doc_id", "term"]
        ),
        lambda: StoredPostings.write(view.title, f"{path}/title"),
        lambda: Bucketed.write(docs.select("id", "doc_id"), f"{path}/ids", "id", n_parts, ["doc_id"]),
        lambda: tags.parquet(f"{path}/tags"),
    )
    return _opened(docs.sparkSession, path, stored)


def open_index(spark: SparkSession, path: str) -> Index:
    docs = Clustered(
        _valid(spark.read.parquet(f"{path}/docs")), spark.read.parquet(f"{path}/bounds")
    )
    return _opened(spark, path, docs)


def _opened(spark: SparkSession, path: str, docs: Clustered) -> Index:
    stored = Stored(
        docs,
        StoredPostings.open(spark, f"{path}/text"),
        StoredPostings.open(spark, f"{path}/title"),
        Clustered.open(spark, f"{path}/forward", _FORWARD),
        Bucketed.open(spark, f"{path}/ids", _IDS, "id"),
    )
    return Index(
        docs.rows.drop("part"),
        stored.text.pairs,
        stored.title.pairs,
        spark.read.parquet(f"{path}/tags"),
        stored,
    )


def restrict_to_terms(term_postings: DataFrame, terms: list[str]) -> DataFrame:
    """Only the postings of a short list of terms, as a filter the Parquet reader understands."""
    return term_postings.filter(in_list("term", terms, term_postings.sparkSession))
