"""From items and vectors to the final table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidforge.functions.tokens import code_columns, render_tokens
from sidforge.operators.collisions import dedup_rank
from sidforge.operators.joins import finalize, join_index, lookup_mem, with_geo_sid
from sidforge.operators.merges import MIN_COUNT, V_MEM, learn_merges, seq_freq, seq_mem_table
from sidforge.operators.quantize import assign_codes
from sidforge.session import materialize


def build_index(
    vectors: DataFrame, codebook: DataFrame, vec: str = "embedding", dedup: bool = True
) -> DataFrame:
    """Index table: ``idx`` and one token per level, the dedup rank as the last."""
    codes = materialize(assign_codes(vectors, codebook, vec, ["idx"]), "codes")
    return render_tokens(dedup_rank(codes) if dedup else codes)


def gen_columns(index: DataFrame) -> list[str]:
    """Code columns without the dedup level."""
    return code_columns(index)[:-1]


def build_geo_sid(items: DataFrame, index: DataFrame, fill_nulls: bool = True) -> DataFrame:
    """Items beside their ``geo_sid``, keyed by ``idx``."""
    return finalize(with_geo_sid(join_index(items, index)), ["geo_sid"], fill_nulls, ["idx"])


def build_final(
    items: DataFrame, index: DataFrame, v_mem: int = V_MEM, min_count: int = MIN_COUNT
) -> DataFrame:
    """Items beside ``geo_sid`` and ``mem_sid``, keyed by ``idx``."""
    gen = gen_columns(index)
    joined = with_geo_sid(join_index(items, index))
    if len(gen) < 2:
        found = joined.withColumn("mem_sid", F.lit(""))
    else:
        _, corpus, _ = learn_merges(seq_freq(index, gen), v_mem, min_count)
        found = lookup_mem(joined, seq_mem_table(corpus, gen), gen)
    return finalize(found, ["geo_sid", "mem_sid"], True, ["idx"])
