"""What speaks for each pattern: names, weights and texts of evidence."""

from __future__ import annotations

# Type of evidence, weight and text, in the order of a detector's evidence. What follows a
# slash tells apart texts or weights of one type and isn't part of the type.
EVIDENCE: dict[str, dict[str, tuple[float, str]]] = {
    "brute_force": {
        "nested_loops": (0.35, "Nested loop structure indicating exhaustive iteration"),
        "range_enumeration": (0.20, "Range-based exhaustive iteration: {}"),
        "pair_wise_check": (0.25, "Element comparison: {}"),
        "recursive_branching/calls": (0.20, "Function '{}' has {} recursive calls indicating exhaustive branching"),
        "recursive_branching/loop": (0.25, "Function '{}' has recursion with loop-based branching"),
    },
    "array_traversal": {
        "for_loop_over_collection": (0.35, "Iteration over collection '{}'"),
        "iterator_based_loop": (0.35, "Iterator-based loop: {}"),
        "subscript_access": (0.35, "Element access via subscript: {}"),
        "element_update": (0.30, "Sequential element update: {}"),
        "element_usage": (0.30, "Loop variable '{}' used in body"),
    },
    "sorting": {
        "sort_method_call": (0.40, "In-place sort method call: {}"),
        "sorted_function_call": (0.40, "Sorted function call: {}"),
        "custom_sort_key": (0.20, "Sort with custom key function: {}"),
    },
    "hash_map_lookup": {
        "dict_creation/empty": (0.25, "Empty dictionary creation: {} = {{}}"),
        "dict_creation": (0.25, "Dict creation: {}"),
        "set_creation": (0.25, "Set creation: {}"),
        "dict_comp_creation": (0.20, "Dict comprehension creation: {}"),
        "membership_check": (0.35, "Membership check: {}"),
        "loop_structure": (0.20, "Loop providing lookup context"),
        "comprehension_iteration": (0.15, "Comprehension providing lookup context"),
    },
    "hash_map_frequency": {
        "empty_dict_creation": (0.25, "Empty dictionary for counting: {} = {{}}"),
        "dict_constructor": (0.25, "Dictionary constructor for counting: {} = dict()"),
        "frequency_increment": (0.35, "Frequency increment pattern: {}"),
        "counting_loop": (0.20, "Loop over elements"),
        "counter_import": (0.20, "Import of {} from collections"),
        "counter_constructor": (0.30, "Counter/defaultdict constructor call"),
    },
    "two_pointers_same": {
        "slow_fast_differential": (0.40, "While loop with {} pointer variables and differential speed ({})"),
        "offset_pointer_assignment": (0.30, "Loop with {} pointer variables; {} in condition"),
    },
    "two_pointers_opposite": {
        "left_pointer_increment": (0.25, "Left pointer '{}' increments toward center"),
        "right_pointer_decrement": (0.25, "Right pointer '{}' decrements toward center"),
        "convergence_loop": (0.40, "While loop converging {} < {}"),
    },
    "sliding_window_fixed": {
        "window_size_check": (0.30, "Fixed window boundary check involving '{}'"),
        "window_expand": (0.20, "Window expansion via '{}' advancing"),
        "window_shrink_fixed": (0.35, "Fixed window maintenance: {}"),
    },
    "sliding_window_variable": {
        "window_shrink_variable/loop": (0.40, "Variable window shrink via '{}++' in inner while loop"),
        "window_expand": (0.20, "Window expands via right pointer '{}'"),
        "window_validity_check": (0.30, "Window validity condition in while loop"),
        "window_shrink_variable/assignment": (0.35, "Variable window shrink via assignment to '{}'"),
    },
    "prefix_sum": {
        "prefix_array_construction": (0.40, "Prefix array built in loop with cumulative formula"),
        "prefix_accumulator": (0.30, "Cumulative accumulation in loop body"),
        "running_sum_update": (0.30, "Running sum '{}' updated in loop"),
        "dictionary_prefix_lookup": (0.35, "Prefix sums stored in dictionary for O(1) lookup"),
    },
    "binary_search_standard": {
        "binary_midpoint": (0.35, "Midpoint calculation: (left + right) // 2"),
        "boundary_update": (0.25, "Boundary update: left = mid + 1 or right = mid - 1"),
        "mid_comparison": (0.30, "Element comparison at mid index"),
        "left_right_boundary": (0.20, "Binary search while loop with left/right boundaries"),
    },
    "binary_search_answer": {
        "answer_midpoint": (0.30, "Midpoint calculation in answer space"),
        "feasibility_check": (0.40, "Feasibility check on mid value"),
        "answer_boundary_update": (0.25, "Boundary update based on feasibility: high = mid or low = mid + 1"),
        "feasibility_loop": (0.20, "Answer-space binary search while loop"),
    },
    "heap_top_k": {
        "heap_push": (0.35, "Heap push: {}"),
        "heap_pop": (0.35, "Heap pop: {}"),
        "heapify_call": (0.25, "Heapify: {}"),
        "nlargest_nsmallest": (0.25, "Heap nlargest/nsmallest: {}"),
    },
    "monotonic_stack": {
        "monotonic_pop": (0.40, "Comparison-driven pop from '{}' with {}"),
        "stack_push": (0.25, "Push to stack '{}'"),
        "comparison_loop": (0.30, "For loop with monotonic stack maintenance"),
    },
    "monotonic_deque": {
        "monotonic_pop": (0.35, "Comparison-driven pop from deque '{}'"),
        "queue_append": (0.20, "Append to deque '{}'"),
        "queue_popleft": (0.30, "Popleft from deque '{}'"),
        "deque_creation": (0.20, "Deque '{}' used in monotonic queue pattern"),
    },
    "fast_slow_pointers": {
        "pointer_names": (0.20, "Traditional fast/slow pointer variable names found: {}"),
        "floyd_traversal": (0.60, "Linked-list traversal with {} pointers at differential speeds ({})"),
        "cycle_check": (0.40, "Cycle detection comparison: {} == {}"),
    },
    "linked_list_reversal": {
        "pointer_rewiring": (0.50, "Linked-list pointer rewiring (e.g., curr.next = prev) found in loop body"),
        "prev_curr_update": (0.30, "Pointer shifting updates (e.g., prev = curr; curr = next) found in loop body"),
        "reversal_variable_names": (0.20, "Traditional linked list reversal variable names found: {}"),
        "recursive_rewiring": (0.60, "Recursive linked-list pointer rewiring (e.g., {0}.next.next = {0}) found"),
        "recursive_call_with_next": (0.40, "Recursive call passing next node (e.g., {}(node.next))"),
    },
    "dfs_recursive": {
        "recursive_call": (0.35, "Recursive self-call to '{}' found"),
        "graph_traversal": (0.30, "For-loop iteration over neighbors/children/adjacent nodes"),
        "child_recursion": (0.25, "Recursive call with child attribute (.left or .right)"),
        "grid_expansion": (0.25, "Multiple recursive calls with direction offsets (grid DFS)"),
        "visited_tracking": (0.20, "Visited-tracking operations (visited.add, node in visited, etc.)"),
        "base_case": (0.20, "Base-case check for None/null in recursive function"),
    },
    "dfs_iterative": {
        "explicit_stack": (0.35, "Explicit stack variable '{}' used with while loop"),
        "stack_traversal": (0.30, "Pop from '{}' followed by child/neighbor iteration"),
        "child_push": (0.25, "Children/neighbors pushed onto '{}' after pop"),
        "visited_tracking": (0.20, "Visited set used to avoid revisiting nodes"),
    },
    "bfs_level_order": {
        "queue_popleft": (0.35, "Popleft from '{}' in while loop"),
        "child_enqueue": (0.30, "Children appended to '{}' in loop"),
        "level_tracking": (0.25, "Level-by-level processing with level-size measurement"),
        "deque_import": (0.20, "Deque imported from collections"),
        "distance_tracking": (0.10, "Distance/step tracking found (shortest path BFS)"),
        "visited_tracking": (0.10, "Visited set found (graph BFS)"),
    },
    "bfs_shortest_path": {
        "queue_traversal": (0.30, "BFS queue traversal with '{}' and popleft"),
        "distance_tracking": (0.25, "Distance/step tracking variable incremented per level"),
        "visited_set": (0.20, "Visited set used to avoid reprocessing nodes"),
        "neighbor_expansion": (0.25, "Iteration over neighbors/adjacent nodes for graph expansion"),
        "level_for_loop": (0.20, "For-loop over current level size for level-by-level processing"),
    },
    "binary_search_tree": {
        "bst_comparison": (0.30, "BST ordering comparison (val < node.val or val > node.val)"),
        "bst_recursion": (0.25, "Recursive call with .left or .right child in BST context"),
        "min_max_constraint": (0.25, "Min/max bound parameters for BST validation"),
        "bst_operation": (0.30, "BST operation (search/insert/delete with BST ordering)"),
    },
    "topological_sort": {
        "indegree_array": (0.30, "Indegree array creation for dependency tracking"),
        "indegree_increment": (0.25, "Indegree increment in edge-processing loop"),
        "indegree_decrement": (0.25, "Indegree decrement when processing dependencies"),
        "zero_indegree_queue": (0.30, "Queue initialized with zero-indegree nodes"),
        "conditional_enqueue": (0.25, "Conditional enqueue when indegree reaches zero"),
    },
    "union_find": {
        "parent_array": (0.25, "Parent array initialized for disjoint set"),
        "find_recursive": (0.30, "Recursive find with path compression"),
        "find_iterative": (0.25, "Iterative find with path compression"),
        "union_operation": (0.30, "Union operation merging two disjoint sets"),
        "connected_check": (0.20, "Connected check using find on both elements"),
        "rank_optimization": (0.25, "Union by rank/size for balanced tree"),
    },
    "binary_search_rotated": {
        "rotated_midpoint": (0.20, "Midpoint calculation in rotated binary search"),
        "sorted_half_comparison": (0.35, "Sorted-half comparison: nums[left] <= nums[mid] or nums[mid] <= nums[right]"),
        "target_range_check": (0.25, "Target-in-sorted-half range check"),
        "rotated_boundary_update": (0.25, "Boundary update based on sorted-half logic"),
    },
    "greedy_local": {
        "local_optimum_selection": (0.35, "Local optimum selection via max/min or running best"),
        "immediate_decision": (0.30, "Immediate decision committing to a locally optimal choice"),
        "forward_progress": (0.25, "Forward progress via index/pointer advancing monotonically"),
    },
    "greedy_interval": {
        "interval_sorting": (0.30, "Sorting intervals by start or end value"),
        "interval_comparison": (0.25, "Comparing interval start/end values in conditionals"),
        "interval_merge_scheduling": (0.30, "Interval merge or scheduling operation"),
        "greedy_selection": (0.25, "Greedy selection of intervals"),
    },
    "backtracking_subset": {
        "choose_recurse_unchoose": (0.35, "Choose/recurse/unchoose pattern with append and pop"),
        "recursive_branching": (0.30, "Multiple recursive calls exploring different branches"),
        "state_restoration": (0.25, "State restoration via pop or backtrack after recursion"),
        "subset_generation": (0.20, "Building subset result by adding partial selections"),
    },
    "backtracking_permutation": {
        "swap_recurse_swap": (0.35, "Swap/recurse/swap pattern for in-place permutation"),
        "visited_array": (0.25, "Visited/used boolean array for tracking selected elements"),
        "permutation_generation": (0.30, "Building permutation result by appending elements"),
        "recursive_exploration": (0.20, "Recursive call with incremented index"),
    },
    "dp_1d_forward": {
        "dp_array_1d": (0.25, "1D DP array created via list multiplication"),
        "table_fill_loop": (0.20, "For-loop filling DP array with index writes"),
        "index_lookback": (0.30, "Index lookback dp[i-1], dp[i-2] read during table fill"),
        "multi_level_lookback": (0.0, "Multi-level index lookback at two or more levels deep"),
        "recursive_lookback": (0.25, "Recursive calls with arithmetic arguments (memoized subproblem lookback)"),
        "cache_decorator": (0.30, "Cache decorator on recursive function"),
        "recurrence_expression": (0.20, "Recurrence expression combining lookback terms via arithmetic"),
        "max_min_recurrence": (0.20, "Max/min recurrence expression combining multiple subproblem results"),
        "base_case_return": (0.15, "Base case return for n <= 1 or boundary initialization"),
        "result_aggregation": (0.15, "Result aggregation via return dp[n] or dp[-1]"),
        "conditional_recurrence": (0.0, "Conditional branching in recurrence, not pure accumulation"),
    },
    "dp_state_machine": {
        "state_variables": (0.30, "Multiple named state variables detected"),
        "state_transition": (0.30, "State transition via max/min between competing states"),
        "dp_array_1d": (0.20, "Small fixed-size DP array for state machine"),
        "table_fill_loop": (0.20, "Single loop iterating over input, updating states"),
        "cache_decorator": (0.30, "Cache decorator on recursive state machine function"),
        "result_aggregation": (0.20, "Result aggregation via max of states"),
    },
    "dp_1d_sequence": {
        "nested_fill_loops": (0.25, "Two-level nested loop filling DP array"),
        "inner_lookback": (0.25, "dp[j] read inside inner loop for sequence lookback"),
        "dp_array_1d": (0.25, "1D DP array created via list multiplication"),
        "recurrence_expression": (0.20, "Recurrence combining dp[i] and dp[j] via max/min"),
        "result_aggregation": (0.20, "Result aggregation via max/min over entire DP array"),
    },
    "dp_2d_grid": {
        "grid_lookback": (0.30, "Grid lookback dp[r-1][c], dp[r][c-1] in recurrence"),
        "nested_fill_loops": (0.20, "Two-level nested loop over grid rows and columns"),
        "dp_array_2d": (0.30, "2D DP array via nested list comprehension"),
        "recurrence_expression": (0.20, "Grid recurrence expression combining lookback terms"),
        "result_aggregation": (0.15, "Result aggregation returning dp[-1][-1] or corner cell"),
        "base_case_return": (0.15, "Base case for grid boundary initialization"),
        "string_compare": (0.30, "String character comparison in nested loops"),
    },
    "dp_2d_string": {
        "string_compare": (0.30, "String character comparison in nested loops"),
        "grid_lookback": (0.25, "Grid lookback dp[i-1][j-1], dp[i-1][j] in recurrence"),
        "dp_array_2d": (0.25, "2D DP array for string alignment"),
        "nested_fill_loops": (0.20, "Two-level nested loop over string indices"),
        "recurrence_expression": (0.20, "String DP recurrence with max/min combining lookback"),
        "base_case_return": (0.15, "Base case initialization for string DP boundaries"),
        "result_aggregation": (0.15, "Result aggregation returning dp[m][n]"),
    },
    "dp_knapsack": {
        "capacity_compare": (0.30, "Capacity vs weight comparison in if-statement"),
        "max_min_recurrence": (0.25, "Max/min recurrence with DP lookback and value/weight"),
        "dp_array_2d": (0.25, "2D DP array for knapsack items and capacity"),
        "nested_fill_loops": (0.20, "Two-level nested loop: items outer, capacity inner"),
        "grid_lookback": (0.20, "Grid lookback dp[i-1][c], dp[i-1][c-w[i]]"),
        "result_aggregation": (0.15, "Result aggregation returning dp[-1][cap]"),
    },
    "dp_interval": {
        "length_based_loop": (0.35, "Length-based outer loop over interval/gap size — primary interval DP signal"),
        "dp_array_2d": (0.25, "2D DP array for interval table"),
        "pair_loop": (0.25, "Pair loop i..j interval pair inside length-based iteration"),
        "grid_lookback": (0.25, "Grid lookback with partition dp[i][k] + dp[k+1][j]"),
        "recurrence_expression": (0.25, "Interval recurrence with max/min over partition points"),
        "partition_lookback": (0.20, "Partition lookback dp[i][k] + dp[k+1][j] pattern"),
        "result_aggregation": (0.15, "Result aggregation returning dp[0][n-1]"),
    },
}
