"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairlab.llm import decontaminate, hosts, lm, mix, near_dup, pii, quality, repeats, shard, spelling, token_codec, trie, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bootstrapped_pii": pii.op1_bootstrapped_pii,
    "op2_backoff_automaton": lm.op2_backoff_automaton,
    "op3_token_range_coder": token_codec.op3_token_range_coder,
    "op4_cgk_leaks": decontaminate.op4_cgk_leaks,
    "op5_bayes_minhash": near_dup.op5_bayes_minhash,
    "op6_weighted_mix": mix.op6_weighted_mix,
    "op7_jump_hash_shards": shard.op7_jump_hash_shards,
    "op8_rule_ledger": quality.op8_rule_ledger,
    "op9_host_reputation": hosts.op9_host_reputation,
    "op10_seekable_warc": warc.op10_seekable_warc,
    "op11_double_array_trie": trie.op11_double_array_trie,
    "op12_reduced_alphabet": spelling.op12_reduced_alphabet,
    "op13_run_length_index": repeats.op13_run_length_index,
}

#: DuckDB SQL; the other queries are tested against brute-force versions
ORACLES: dict[str, str] = {
    "op5_bayes_minhash": near_dup.ORACLE,
    "op6_weighted_mix": mix.ORACLE,
    "op9_host_reputation": hosts.ORACLE,
    "op10_seekable_warc": warc.ORACLE,
    "op11_double_array_trie": trie.ORACLE,
    "op12_reduced_alphabet": spelling.ORACLE,
    "op13_run_length_index": repeats.ORACLE,
}
