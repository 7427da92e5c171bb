"""The pN_ queries of the llm subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchbill.llm.canonical import map_to_list
from watchbill.llm.lookalikes import same_look
from watchbill.llm.mixing import mix, shares
from watchbill.llm.packing import fills, pack
from watchbill.llm.subjects import subject_areas
from watchbill.llm.tokens import n_tokens
from watchbill.llm.variants import person_pairs, phone_key, same_person
from watchbill.operators.multivalue import values_of
from watchbill.sources.tables import table, written


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    contact = table(spark, sf_dir, "contact").select(F.col("contact_id").alias("id"), "site_code", "name", "phone", "specialty")
    edit = table(spark, sf_dir, "rota_edit").select(F.col("edit_id").alias("id"), "site_code", F.col("doctor").alias("name"), "phone", "specialty")
    return same_person(contact.unionByName(edit), "id", "site_code", "name", "phone", "specialty")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows of contact and rota_edit of a site that mean the same person or unit."""
    return person_pairs(_people(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and contacts of a site whose names look the same but are other characters."""
    one = table(spark, sf_dir, "entry").select("entry_id", "site_code", "name").where(F.size(values_of(F.col("name"))) < 2)
    one = written(one)  # read three times: taking fields apart costs more than storing what is left
    return same_look(one, table(spark, sf_dir, "contact"), ["site_code"], "name", "name", "entry_id", "contact_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person of manual_phone meant by each entry with an uncertain phone, 0 if nobody is."""
    entry = table(spark, sf_dir, "entry")
    listed = table(spark, sf_dir, "manual_phone").select(F.col("manual_id").alias("id"), F.col("full_name").alias("name"), "phone", phone_key(F.col("phone")).alias("_p"))
    used = entry.groupBy(phone_key(F.col("phone")).alias("_p")).agg(F.count("*").alias("uses")).where("_p is not null")
    listed = listed.join(used, "_p", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    meant = map_to_list(entry.where("phoneuncertain").select("entry_id", "name", "phone"), "name", "phone", listed, F.col("uses"))
    return meant.select("entry_id", F.col("best_id").alias("manual_id"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their sizes in tokens, counted once."""
    return written(table(spark, sf_dir, "documents").select("doc_id", "source", n_tokens(F.col("text")).alias("tokens")))


def p7_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each text, or piece of an oversized text, for each capacity of pack_target."""
    return pack(_sized(spark, sf_dir), table(spark, sf_dir, "pack_target"), "doc_id", "tokens")


def p7_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are, against the fewest that could hold all tokens."""
    return fills(p7_bins(spark, sf_dir), table(spark, sf_dir, "pack_target"))


def p7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What p7_bins must keep: every text placed, no container over its capacity, no text cut that fits, no token twice."""
    packed, sized = p7_bins(spark, sf_dir), _sized(spark, sf_dir).where("tokens > 0")
    kinds = table(spark, sf_dir, "pack_target").select("pack_name", "capacity_tokens")
    bins = packed.groupBy("pack_name", "bin").agg(F.sum("tokens").alias("n")).join(kinds, "pack_name")
    over = bins.groupBy("pack_name").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("overfull"))
    texts = packed.groupBy("pack_name", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("placed")).join(sized.select("doc_id", "tokens"), "doc_id").join(kinds, "pack_name")
    cut = (F.col("tokens") <= F.col("capacity_tokens")) & (F.col("pieces") > 1)
    out = texts.groupBy("pack_name").agg(F.count("*").alias("texts"), F.count_if(cut).alias("cut"), F.count_if(F.col("placed") != F.col("tokens")).alias("misplaced"))
    return out.join(over, "pack_name").select("pack_name", "texts", "overfull", "cut", "misplaced")


def p8_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What p8_mixture must keep: no text oftener than its source may repeat, each pass of a text once, no other source."""
    mixed = p8_mixture(spark, sf_dir)
    once = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.max("pass_no").alias("last"))
    targets = table(spark, sf_dir, "mix_target").select("source", "max_repeat")
    both = once.join(targets, "source", "full")
    return both.groupBy("source").agg(
        F.count_if(F.col("n") > F.col("max_repeat")).alias("too_often"), F.count_if(F.col("n") != F.col("last")).alias("passes_missing"), F.count_if(F.col("max_repeat").isNull()).alias("unknown"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of the sources of documents, in the order of slot."""
    return mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_target"), "doc_id", "source", "tokens")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the mixture really reached."""
    return shares(p8_mixture(spark, sf_dir), table(spark, sf_dir, "mix_target"))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_areas(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_label"), table(spark, sf_dir, "subject_area"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of each document."""
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subject's share of the documents' tokens against its target; a document counts by the shares of its subjects."""
    sized = _sized(spark, sf_dir)
    parts = _subjects(spark, sf_dir).join(sized, "doc_id").groupBy("subject").agg(F.sum(F.col("share") * F.col("tokens")).alias("n"), F.countDistinct("doc_id").alias("documents"))
    out = table(spark, sf_dir, "subject_area").join(parts, "subject", "left").crossJoin(F.broadcast(parts.agg(F.sum("n").alias("whole"))))
    share = F.coalesce(F.col("n") / F.col("whole"), F.lit(0.0))
    return out.select("subject", F.coalesce("documents", F.lit(0)).alias("documents"), share.alias("share"), "target_share", (F.col("target_share") / share).alias("weight"))


QUERIES = {f.__name__: f for f in (p4_found, p5_found, p6_found, p7_bins, p7_fills, p7_audit, p8_mixture, p8_shares, p8_audit, p9_found, p9_composition)}
ORACLE: dict[str, str] = {
    # what must hold, without the tokenizer: every text with a letter has tokens
    "p7_audit": "select pack_name, (select count(*) from documents where text <> '') as texts, 0 as overfull, 0 as cut, 0 as misplaced from pack_target",
    "p8_audit": "select source, 0 as too_often, 0 as passes_missing, 0 as unknown from mix_target",
}
