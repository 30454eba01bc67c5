"""All registered queries and oracles."""

from __future__ import annotations

from tunelens.plans import evaluation_queries, model_queries, prompt_queries

_MODULES = (prompt_queries, evaluation_queries, model_queries)

# Integer widths that SQL arithmetic would otherwise choose differently from Spark.
_WIDTHS = {
    "INTEGER": {
        "normalise_sentence": ["n_chars"],
        "answer_index": ["answer_index"],
        "label_to_option": ["correct_option"],
        "reward_input": ["n_messages", "correct_option"],
        "patch_system": ["n_messages"],
        "paired_prompts": ["prompt_len"],
        "paired_text_prompts": ["prompt_len"],
        "max_length": ["max_len"],
        "filter_length": ["prompt_len"],
        "split_files": ["correct_option"],
        "union_splits": ["correct_option"],
        "rewrite_dataset": ["n_messages"],
        "expand_samples": ["sample_id"],
        "align_responses": ["n_chars"],
        "audit_rows": ["truth"],
        "position_jsd": ["pos"],
        "reverse_kl": ["pos"],
        "split_position_jsd": ["pos"],
        "split_reverse_kl": ["pos"],
        "update_mask": ["i"],
    },
    "BIGINT": {
        "read_all": ["n_chars"],
        "assign_batches": ["n_chars"],
        "step_plan": ["updates_per_iteration"],
    },
}


def _typed(name: str, sql: str) -> str:
    casts = [
        f"CAST({column} AS {width}) AS {column}" for width, columns in _WIDTHS.items() for column in columns.get(name, [])
    ]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})" if casts else sql


QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: _typed(name, sql) for module in _MODULES for name, sql in module.ORACLES.items()}
