"""Best-fit packing with large-item matching."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weir.llm.pieces import Plan, packed, partner


def large_item_plan(counts: dict[int, int], capacity: int) -> Plan:
    """Pieces above a third of the capacity stand at most two in a bin: the largest left is matched with the largest that
    fits beside it. The smaller ones then go, longest first, into the tightest gap that takes them."""
    plan = Plan(counts, capacity)
    large = sorted(n for n in counts if 3 * n > capacity)
    while large:
        length = large[-1]
        if not plan.left[length]:
            large.pop()
            continue
        mate = partner(large, plan.left, capacity - length)
        if mate == length and plan.left[length] == 1:  # it cannot stand beside itself
            mate = partner(large[:-1], plan.left, capacity - length)
        if mate == length:
            n = plan.left[length] // 2
            plan.put(length, first := plan.new_bins(n), n, 2, 0)
        else:
            n = min(plan.left[length], plan.left[mate]) if mate else plan.left[length]
            plan.put(length, first := plan.new_bins(n), n, 1, 0)
            if mate:
                plan.put(mate, first, n, 1, length)
        plan.open.add(capacity - length - mate, first, n, length + mate)
    for length in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        plan.best_fit(length)
    return plan


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents in sequences of at most `capacity` tokens: one row per piece.

    Returns (id, piece, start, length, ids_crc32, sequence_id, offset). Only documents of more than `capacity` tokens are
    cut. A null or empty text is one end token; repeated rows are packed each; null ids are kept; an empty table gives no
    rows; other columns are not read.
    """
    return packed(docs, vocabulary, capacity, end_id, large_item_plan, id_col=id_col, text_col=text_col)
