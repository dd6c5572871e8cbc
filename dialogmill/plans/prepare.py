"""Files in, training dataset out: the whole preparation as one Spark job.

    spark-submit -m dialogmill.plans.prepare --out FOLDER --system-prompt TEXT PATH ...
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmill.operators.templates import TEMPLATES, USER_ASSISTANT, TemplateSpec, render
from dialogmill.operators.tokens import MAX_LENGTH
from dialogmill.operators.vocab import SpecialTokens, learn_vocab
from dialogmill.plans.training import tokenized_rows
from dialogmill.sources import files, sinks

#: What orders rows as the input lists them.
INPUT_ORDER = ("source_no", "source_path", "row_id")


def prepare(
    spark: SparkSession,
    paths: Sequence[str],
    system_prompt: str,
    out: str,
    spec: TemplateSpec = USER_ASSISTANT,
    vocab: DataFrame | None = None,
    vocab_entries: int | None = None,
    special: SpecialTokens = SpecialTokens(),
    length: int = MAX_LENGTH,
    shard_bytes: int = sinks.SHARD_BYTES,
) -> list[str]:
    """Write ``text``, ``rejected``, ``vocab``, ``tokens`` and ``metrics`` below
    ``out``; return the skipped paths.

    The rendered text is written first, in the order of the input and in shards of at
    most ``shard_bytes``, and read again for the later steps, so that source files
    are parsed once. Without a given ``vocab`` one is learned
    from the text.
    """
    conversations, rejected, skipped = files.read_conversations(spark, paths, system_prompt)
    rendered = conversations.select(
        # a folder has many files with one place, so the file is part of the key
        F.concat(F.col("source_no"), F.lit(":"), F.md5("source_path"), F.lit(":"), F.col("row_id")).alias("row_key"),
        render(F.col("messages"), spec).alias("text"),
        *INPUT_ORDER,
    )
    sinks.write_shards(rendered, f"{out}/text", INPUT_ORDER, shard_bytes, "parquet")
    rejected.write.parquet(f"{out}/rejected")
    texts = spark.read.parquet(f"{out}/text").select("row_key", "text")

    learned = learn_vocab(texts, "text", vocab_entries, special) if vocab is None else vocab
    sinks.write_with_size(learned, f"{out}/vocab", f"{out}/metrics", "vocab_size", special.reserved)
    known = spark.read.parquet(f"{out}/vocab")
    sinks.write_tokens(tokenized_rows(texts, known, special, length), f"{out}/tokens", length)
    return skipped


def main() -> None:
    parser = argparse.ArgumentParser(description="Prepare chat training data")
    parser.add_argument("paths", nargs="+", help="TXT and CSV files or folders of that suffix")
    parser.add_argument("--out", required=True)
    parser.add_argument("--system-prompt", required=True)
    parser.add_argument("--template", choices=sorted(TEMPLATES), default=USER_ASSISTANT.name)
    parser.add_argument("--vocab-entries", type=int)
    args = parser.parse_args()
    spark = SparkSession.builder.appName("dialogmill-prepare").getOrCreate()
    skipped = prepare(
        spark, args.paths, args.system_prompt, args.out, TEMPLATES[args.template],
        vocab_entries=args.vocab_entries,
    )
    for path in skipped:
        print(f"skipped: {path}")
    spark.stop()


if __name__ == "__main__":
    main()
