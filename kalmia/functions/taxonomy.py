"""The pattern taxonomy: categories, labels and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Categories and their patterns.
CATEGORIES = {
    "arrays": ["hash_map_lookup", "hash_map_frequency", "prefix_sum", "sliding_window_fixed", "sliding_window_variable", "two_pointers_opposite", "two_pointers_same"],
    "trees_graphs": ["dfs_recursive", "dfs_iterative", "bfs_level_order", "bfs_shortest_path", "topological_sort", "union_find", "binary_search_tree"],
    "dp": ["dp_1d_forward", "dp_1d_sequence", "dp_2d_grid", "dp_2d_string", "dp_knapsack", "dp_interval", "dp_state_machine"],
    "linked_lists": ["fast_slow_pointers", "linked_list_reversal", "monotonic_stack", "monotonic_deque"],
    "binary_search": ["binary_search_standard", "binary_search_rotated", "binary_search_answer"],
    "greedy_backtracking": ["heap_top_k", "greedy_local", "greedy_interval", "backtracking_permutation", "backtracking_subset"],
}
# Labels.
LABELS = {
    "hash_map_lookup": "Hash Map Lookup", "hash_map_frequency": "Hash Map Frequency", "prefix_sum": "Prefix Sum",
    "sliding_window_fixed": "Fixed Sliding Window", "sliding_window_variable": "Sliding Window", "two_pointers_opposite": "Two Pointers",
    "two_pointers_same": "Two Pointers (Same Direction)", "dfs_recursive": "Depth-First Search", "dfs_iterative": "Depth-First Search (Iterative)",
    "bfs_level_order": "Breadth-First Search", "bfs_shortest_path": "Breadth-First Search (Shortest Path)", "topological_sort": "Topological Sort",
    "union_find": "Union-Find", "binary_search_tree": "Binary Search Tree", "dp_1d_forward": "1D Dynamic Programming", "dp_1d_sequence": "1D Sequence DP",
    "dp_2d_grid": "2D Grid DP", "dp_2d_string": "2D String DP", "dp_knapsack": "Knapsack DP", "dp_interval": "Interval DP", "dp_state_machine": "State Machine DP",
    "fast_slow_pointers": "Fast & Slow Pointers", "linked_list_reversal": "Linked List Reversal", "monotonic_stack": "Monotonic Stack",
    "monotonic_deque": "Monotonic Deque", "binary_search_standard": "Binary Search", "binary_search_rotated": "Binary Search (Rotated)",
    "binary_search_answer": "Binary Search on Answer", "heap_top_k": "Heap / Top K", "greedy_local": "Greedy", "greedy_interval": "Greedy (Intervals)",
    "backtracking_permutation": "Backtracking (Permutations)", "backtracking_subset": "Backtracking (Subsets)",
}
# Problem-set tags.
TAGS = {
    "hash_map_lookup": "hash-table", "hash_map_frequency": "hash-table", "prefix_sum": "prefix-sum", "sliding_window_fixed": "sliding-window",
    "sliding_window_variable": "sliding-window", "two_pointers_opposite": "two-pointers", "two_pointers_same": "two-pointers",
    "dfs_recursive": "depth-first-search", "dfs_iterative": "depth-first-search", "bfs_level_order": "breadth-first-search", "bfs_shortest_path": "breadth-first-search",
    "topological_sort": "topological-sort", "union_find": "union-find", "binary_search_tree": "binary-search-tree",
    **dict.fromkeys(["dp_1d_forward", "dp_1d_sequence", "dp_2d_grid", "dp_2d_string", "dp_knapsack", "dp_interval", "dp_state_machine"], "dynamic-programming"),
    "fast_slow_pointers": "linked-list", "linked_list_reversal": "linked-list", "monotonic_stack": "monotonic-stack", "monotonic_deque": "queue",
    "binary_search_standard": "binary-search", "binary_search_rotated": "binary-search", "binary_search_answer": "binary-search", "heap_top_k": "heap-priority-queue",
    "greedy_local": "greedy", "greedy_interval": "greedy", "backtracking_permutation": "backtracking", "backtracking_subset": "backtracking",
}
#: Detected, but outside the taxonomy.
EXTRA = ("array_traversal", "brute_force", "sorting")
#: The adapter's order: the first 27 are some problem's primary pattern.
ORDER = (
    "hash_map_lookup", "hash_map_frequency", "prefix_sum", "sliding_window_variable", "two_pointers_opposite", "two_pointers_same", "dfs_recursive", "dfs_iterative",
    "bfs_level_order", "bfs_shortest_path", "dp_1d_forward", "dp_1d_sequence", "dp_2d_grid", "dp_2d_string", "dp_knapsack", "fast_slow_pointers", "linked_list_reversal",
    "monotonic_stack", "monotonic_deque", "binary_search_standard", "binary_search_rotated", "binary_search_answer", "heap_top_k", "greedy_local", "greedy_interval",
    "backtracking_permutation", "backtracking_subset", "sliding_window_fixed", "topological_sort", "union_find", "binary_search_tree", "dp_interval", "dp_state_machine",
)
CATEGORY_OF = {p: c for c, patterns in CATEGORIES.items() for p in patterns}

SCHEMA = "ix int, pattern_id string, category string, label string, tag string"


def pattern_dim(spark: SparkSession) -> DataFrame:
    """33 rows; small enough to broadcast by its fixed size."""
    return spark.createDataFrame([(i, p, CATEGORY_OF[p], LABELS[p], TAGS[p]) for i, p in enumerate(ORDER)], SCHEMA)


def pattern_dim_sql() -> str:
    rows = ", ".join(f"({i}, '{p}', '{CATEGORY_OF[p]}', '{LABELS[p]}', '{TAGS[p]}')" for i, p in enumerate(ORDER))
    return f"pattern_dim(ix, pattern_id, category, label, tag) AS (VALUES {rows})"
