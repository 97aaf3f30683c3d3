"""Sources and sinks: tab-separated record files, Parquet landing, result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(n, T.StringType()) for n in ("source1_entity_id", "matched_entity_ids")])

# Values of the derived records: accented letters and their plain forms, the alphabet
# and its stand-ins in two other scripts (one for one), legal forms by number.
ACCENTED = "éèêëàâäáãåçîïíìôöóòõùûüúñÿý"
PLAIN = "eeeeaaaaaaciiiiooooouuuunyy"
LATIN = "abcdefghijklmnopqrstuvwxyz"
DEVANAGARI = "अबचदएफगहइजकलमनओपखरसतउवळषयझ"
TAMIL = "அஆஇஈஉஊஎஏஐஒஓஔகஙசஞடணதநபமயரலவ"
SUFFIXES = ("Inc", "LLC", "Pvt Ltd", "SARL", "")

TRAIN = ("train_source1.tsv", "train_source2.tsv", "train_source3.tsv", "train_ground_truth.tsv")
TEST = ("test_source1.tsv", "test_source2.tsv", "test_source3.tsv")


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD, columns: list[str] | None = None, skip_bad: bool = False) -> DataFrame:
    """All fields as text, blanks as "", never null; columns prunes the scan."""
    d = spark.read.schema(schema).options(sep="\t", header=True, quote='"', escape='"', mode="DROPMALFORMED" if skip_bad else "PERMISSIVE").csv(path)
    return d.select(*(columns or d.columns)).na.fill("")


def write_tsv(df: DataFrame, path: str, key: str | None = "source1_entity_id", one_file: bool = False) -> None:
    """A table with header and tabs, sorted by key if given, else in the order of its rows; "" for empty lists. Distributed unless one_file."""
    if key:
        df = df.coalesce(1).sortWithinPartitions(key) if one_file else df.orderBy(key)
    elif one_file:
        df = df.coalesce(1)
    df.write.mode("overwrite").options(sep="\t", header=True, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def in_order_of(result: DataFrame, entities: DataFrame, key: str = "source1_entity_id") -> DataFrame:
    """The rows of a result in the order in which entities are read, range-sorted, so that the parts of a file keep it."""
    place = entities.select(F.col("entity_id").alias(key), F.monotonically_increasing_id().alias("place"))
    return result.join(place, key).orderBy("place").drop("place")


def write_candidates(wide: DataFrame, long: DataFrame, path: str) -> None:
    """Both forms of a candidate set: one row per query, and one per pair with its strategies."""
    write_tsv(wide, path + "/wide")
    long.withColumn("strategies", F.array_join("strategies", ",")).write.mode("overwrite").options(sep="\t", header=True, emptyValue="").csv(path + "/long")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def discover(spark: SparkSession, folders: list[str], names=TRAIN) -> str:
    """The first folder that has the first of names, in any store that Spark reads; an error if none has."""
    for f in folders:
        if exists(spark, f"{f.rstrip('/')}/{names[0]}"):
            return f.rstrip("/")
    raise FileNotFoundError(f"{names[0]} is in none of {folders}")


def bundle(spark: SparkSession, folder: str, names=TRAIN) -> dict[str, DataFrame]:
    """The tables of a train or test set by file name without ending; a missing file is an error."""
    out = {}
    for n in names:
        if not exists(spark, f"{folder}/{n}"):
            raise FileNotFoundError(f"{folder}/{n}")
        out[n.removesuffix(".tsv")] = read_tsv(spark, f"{folder}/{n}", TRUTH if "truth" in n else RECORD)
    return out


def only_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose entity_id is wanted; a scan in chunks that stops when all are found is a semi-join here."""
    return df.join(ids.select("entity_id"), "entity_id", "left_semi")


def land(df: DataFrame, path: str) -> None:
    """Parquet partitioned by country, so that a country filter prunes directories."""
    df.write.mode("overwrite").partitionBy("country_norm").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def lists_to_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.array_join(c, " ") for c in columns})


def text_to_lists(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.filter(F.split(c, " "), lambda x: x != "") for c in columns})


def longest(text: Column, n: int) -> Column:
    """The n longest different words of a whole text, equal lengths in the order of their letters; "" where there are fewer."""
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}]+"), F.lit(0)))
    ranked = F.slice(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, n)
    return F.transform(ranked, lambda s: s["w"])


def records(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """Linkable records from documents: entity_id, business_name, business_address, country, mark.

    Source i has the documents with doc_id % 3 = i - 1. Every field is made from
    the whole text: a name is its four longest words with a legal form, an
    address a number, the next two words and a postal code; mark is the digest
    of the text's longest line, and records with one mark are the same entity.
    Sources differ as real ones do: some names are written in Devanagari or Tamil
    letters, some by initials, some with a letter changed; some addresses and
    countries are missing, some lack the postal code. Documents without an id
    are no records; other nulls count as empty or 0. tasks deals the texts to so
    many tasks first.
    """
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("n_chars", F.lit(0)).alias("n"))
    d = d.repartition(tasks) if tasks else d
    best = F.array_min(F.transform(F.split("text", "\n"), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))["x"]
    d = d.select("doc_id", "lang", "n", longest(F.col("text"), 6).alias("w"), F.when(best != "", F.md5(F.lower(best))).alias("mark"), (1 + F.col("doc_id") % 3).alias("source"))
    w = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit(""))
    first = lambda i: F.substring(w(i), 1, 1)
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("doc_id") % 5 + 1).cast("int"))
    head = F.when((F.col("source") == 3) & (F.col("n") % 13 == 0), F.replace(w(0), F.lit("e"), F.lit("i"))).otherwise(w(0))
    name = F.when((F.col("source") == 2) & (F.col("n") % 17 == 0), F.concat(*[first(i) for i in range(4)])).otherwise(F.concat(head, F.lit(" "), w(1), F.lit(" "), w(2), F.lit(" "), w(3), F.lit(" "), suffix))
    d = d.withColumn("name", name)
    plain = F.translate(F.lower("name"), ACCENTED, PLAIN)
    name = F.when(F.col("n") % 7 == 0, F.translate(plain, LATIN, DEVANAGARI)).when((F.col("source") == 3) & (F.col("n") % 7 == 1), F.translate(plain, LATIN, TAMIL)).otherwise(F.col("name"))
    bare = (F.col("n") % 11 == 0) | (F.col("source") == 2) & (F.col("n") % 11 == 1)
    code = F.when(bare, "").otherwise(F.concat(F.lit(" "), (10000 + F.col("n") % 500).cast("string")))
    address = F.when(F.col("doc_id") % 31 == 0, "").otherwise(F.concat((F.col("n") % 900).cast("string"), F.lit(" "), w(4), F.lit(" St, "), w(5), code))
    return d.select(
        F.concat(F.lit("S"), F.col("source").cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        name.alias("business_name"),
        address.alias("business_address"),
        F.when(F.col("doc_id") % 97 == 0, "").otherwise(F.col("lang")).alias("country"),
        "mark",
    )


def sources(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries, targets): source 1, and sources 2 and 3."""
    return df.where(F.col("entity_id").startswith("S1-")), df.where(~F.col("entity_id").startswith("S1-"))


def truth(df: DataFrame) -> DataFrame:
    """(s1_id, cand_id) of equal marks."""
    q, t = sources(df)
    return q.select(F.col("entity_id").alias("s1_id"), "mark").join(t.select(F.col("entity_id").alias("cand_id"), "mark"), "mark").select("s1_id", "cand_id")
