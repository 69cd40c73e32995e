"""Line formats: FASTA records, fixed-width atom records, and digests of whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_sequence
from .chained_hash import chained_digests

#: Files up to this size are one row; the endings of codecs that Spark's line reader unpacks.
WHOLE_BYTES, PACKED = 64 << 20, r"(?i)\.(gz|deflate|bz2|lz4|snappy|zst|passthrough)$"


def read_fasta(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records as (path, accession, header, sequence), and those without header or residues.

    Files are split at `>` by the reader, so one large file is read by many tasks.
    """
    raw = spark.read.option("lineSep", ">").text(path).select(F.input_file_name().alias("path"), "value")
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n", 2)
    parsed = raw.where(F.trim("value") != "").select(
        "path",
        F.trim(F.get(lines, F.lit(0))).alias("header"),
        clean_sequence(F.coalesce(F.get(lines, F.lit(1)), F.lit(""))).alias("sequence"),
    )
    named = parsed.withColumn("accession", F.regexp_extract("header", r"^(?:[a-z]+\|)?([^|\s]+)", 1))
    good = (F.col("header") != "") & (F.col("sequence") != "")
    return named.where(good), named.where(~good)


def element_of(name: Column, atom_type: Column) -> Column:
    """Element from the atom type, else from the first letter of the atom name."""
    kind, plain = F.upper(F.trim(atom_type)), F.upper(F.trim(name))
    return (
        F.when(kind.isin("OA", "O"), "O")
        .when(kind.isin("NA", "N"), "N")
        .when(kind.isin("SA", "S"), "S")
        .when(kind.isin("HD", "H"), "H")
        .when(kind.isin("A", "C"), "C")
        .when(plain.startswith("CL"), "CL")
        .otherwise(F.substring(plain, 1, 1))
    )


def atoms_of(files: DataFrame) -> DataFrame:
    """Atom rows of the first model in each (path, value) text; fields sit at fixed columns.

    A pose file is small; each is one row. Coordinates that are not at their columns are
    taken from the numbers of the line, counted from its end.
    """
    first = F.regexp_replace("value", r"(?s)\nENDMDL.*$", "\n")
    first = F.regexp_replace(first, r"(?s)^(.*?\bMODEL[^\n]*\n.*?)\nMODEL.*$", "$1")
    lines = files.select("path", F.posexplode(F.split(first, "\r?\n")).alias("line_no", "line"))
    atoms = lines.where(F.col("line").rlike("^(ATOM|HETATM)"))
    numbers = F.regexp_extract_all("line", F.lit(r"([-+]?[0-9]*\.[0-9]+|[-+]?[0-9]+)"), F.lit(1))

    def coordinate(start: int, from_end: int) -> Column:
        fixed = F.trim(F.substring("line", start, 8)).try_cast("double")
        return F.coalesce(fixed, F.get(numbers, F.size(numbers) - F.lit(from_end)).try_cast("double"))

    kind = F.coalesce(
        F.nullif(F.trim(F.substring("line", 78, 10)), F.lit("")), F.regexp_extract("line", r"(\S+)\s*$", 1)
    )
    name = F.trim(F.substring("line", 13, 4))
    return atoms.select(
        "path", "line_no",
        F.trim(F.substring("line", 7, 5)).try_cast("int").alias("serial"),
        name.alias("name"),
        F.trim(F.substring("line", 18, 3)).alias("residue_name"),
        F.trim(F.substring("line", 22, 1)).alias("chain_id"),
        F.trim(F.substring("line", 23, 4)).try_cast("int").alias("residue_number"),
        coordinate(31, 6).alias("x"), coordinate(39, 5).alias("y"), coordinate(47, 4).alias("z"),
        kind.alias("atom_type"),
        element_of(name, kind).alias("element"),
    )


def read_fixed_width_atoms(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True)
    return atoms_of(raw.select(F.input_file_name().alias("path"), "value"))


def file_digests(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Size and SHA-256 of every file under a path.

    Files over `WHOLE_BYTES` are read in splits and hashed span by span. The reader of splits would unpack files with the
    ending of a codec, so these are always read whole, up to the 2 GB of a value. Spark's readers pass over files of no bytes.
    """
    of = lambda reader: reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    files = of(spark.read.format("binaryFile")).load(path)
    large = (F.col("_metadata.file_size") > WHOLE_BYTES) & ~F.col("_metadata.file_name").rlike(PACKED)
    whole = files.where(~large).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    key = F.col("_metadata.file_path").alias("key")
    named = files.where(large).select("path", "length", key)
    if named.isEmpty():
        return whole
    lines = of(spark.read.format("text").option("lineSep", "\n")).load(path).where(large)
    lines = lines.select(key, F.col("_metadata.file_block_start").alias("start"), "value").withColumnRenamed("key", "path")
    digests = chained_digests(named.select(F.col("key").alias("path"), "length"), lines)
    chained = named.join(digests.withColumnRenamed("path", "key"), "key").select("path", F.col("length").alias("bytes"), "sha256")
    return whole.unionByName(chained)
