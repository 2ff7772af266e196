"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, jaccard, oracles, pages, permutations, quality_model, quality_rules, repeats, templates, toxicity, trie, turns
from .registry import ORACLES, QUERIES, query, read

__all__ = ["ORACLES", "QUERIES", "VOCABULARY"]

#: File of the vocabulary that the queries use, as the tokenizer package names it.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_text(name: str = VOCABULARY) -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


#: What the calls in op1 must look like.
TOOLS = [("reply", '{"type":"object","required":["turn","text"],"additionalProperties":false,"properties":{"turn":{"type":"integer","minimum":0},"text":{"type":"string","minLength":1,"maxLength":400}}}')]


def tool_messages(conversations: DataFrame) -> DataFrame:
    """The turns of conversations as messages: an assistant's turn calls ``reply``, the user's next turn is its result."""
    call = F.concat_ws("_", F.lit("call"), "conv_id", F.col("turn"))
    made = F.array(F.struct(call.alias("id"), F.lit("reply").alias("name"), F.to_json(F.struct("turn", "text")).alias("arguments")))
    answers = F.when((F.col("role") == "user") & (F.col("turn") > 0), F.concat_ws("_", F.lit("call"), "conv_id", F.col("turn") - 1))
    asked = F.col("role") == "assistant"
    return conversations.select(
        "conv_id", "turn", "role", F.when(~asked, F.col("text")).alias("content"), F.when(asked, made).alias("tool_calls"), answers.alias("tool_call_id"))


@query("op1_tool_call_linking", oracles.chats())
def op1_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message, call and result of every conversation, linked, ordered, checked and serialised."""
    tools = spark.createDataFrame(TOOLS, "name string, schema string")
    linked = chat.format_chats(tool_messages(read(spark, sf_dir, "conversations")), tools)
    return linked.select("conv_id", "turn", "kind", "status", F.col("at").alias("at_turn"), F.col("step").cast("long").alias("step"), "valid", F.sha2("json", 256).alias("json_sha256"))


@query("op2_bpe_codec")
def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of ids and of decoded text."""
    return bpe.encode(read(spark, sf_dir, "documents"), vocabulary_text(), digest=True)


@query("op3_ftrl_toxicity")
def op3_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = read(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


@query("op4_line_first_cleaning", oracles.quality())
def op4_line_first_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    cleaned = quality_rules.clean(read(spark, sf_dir, "documents"), with_text=False)
    return cleaned.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


@query("op5_site_template_removal")
def op5_site_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return pages.extract(read(spark, sf_dir, "pages")).drop("n_deleted")


@query("op6_suffix_automaton_decontamination", oracles.contamination())
def op6_suffix_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a window of a test item."""
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


@query("op7_subword_quality")
def op7_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = read(spark, sf_dir, "documents")
    return quality_model.quality(docs, quality_model.train(docs, read(spark, sf_dir, "labels")))


@query("op8_adaptive_prefix_jaccard", oracles.near_duplicates())
def op8_adaptive_prefix_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return jaccard.similar(read(spark, sf_dir, "documents"))


@query("op9_line_template_dedup", oracles.line_templates())
def op9_line_template_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without lines of recurring templates, by the rule of the expected SQL."""
    left = templates.drop_recurring_lines(read(spark, sf_dir, "documents"), by="places")
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("clean_text", 256).alias("clean_sha256"))


@query("line_template_texts")
def line_template_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9's whole operator leaves of every document: texts that hold a line are sketched and counted by what they have in common, a step op9's expected SQL does not state."""
    left = templates.drop_recurring_lines(read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", "clean_text")


@query("op10_interval_tree_repeats")
def op10_interval_tree_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document outside strings that repeat; ``kept_text`` is what is left, with replacement characters where a character was cut."""
    left = repeats.remove_repeats(read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
                       (F.col("n_removed") > 0).alias("repeats"), F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))


@query("op11_permutation_index", oracles.neighbours())
def op11_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth."""
    return permutations.neighbours(read(spark, sf_dir, "embeddings"))


@query("op12_run_length_repair", oracles.repairs())
def op12_run_length_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, and its cheapest repair."""
    return turns.repair_conversations(read(spark, sf_dir, "conversations"))


@query("op13_prefix_trie", oracles.prefix_trie())
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return trie.prefix_trie(read(spark, sf_dir, "conversations"))
