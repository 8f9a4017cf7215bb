"""Code samples: for each pattern one that shows it; and some that show nothing or can't be read."""

from __future__ import annotations

POSITIVE = {
    "brute_force": "def pairs(a, t):\n    for i in range(len(a)):\n        for j in range(i + 1, len(a)):\n            if a[i] + a[j] == t or a[j] > t:\n                return i, j",
    "array_traversal": "def total(nums):\n    s = 0\n    for x in nums:\n        s += x\n    return s",
    "sorting": "def order(people):\n    people.sort(key=lambda p: p.age)\n    return sorted(people)",
    "hash_map_lookup": "def two(nums, t):\n    seen = {}\n    for i, x in enumerate(nums):\n        if t - x in seen:\n            return seen[t - x], i\n        seen[x] = i",
    "hash_map_frequency": "def count(s):\n    d = {}\n    for c in s:\n        d[c] = d.get(c, 0) + 1\n    return d",
    "two_pointers_same": "def skip(a):\n    i = 0\n    j = 0\n    while j < len(a):\n        i += 1\n        j += 2\n    return i",
    "two_pointers_opposite": "def pal(s):\n    i = 0\n    j = len(s) - 1\n    while i < j:\n        if s[i] != s[j]:\n            return False\n        i += 1\n        j -= 1\n    return True",
    "sliding_window_fixed": "def best(a, k):\n    s = 0\n    for i in range(len(a)):\n        s += a[i]\n        if i >= k:\n            s -= a[i - k]\n    return s",
    "sliding_window_variable": "def shortest(a, t):\n    left = 0\n    s = 0\n    for right in range(len(a)):\n        s += a[right]\n        while s >= t:\n            s -= a[left]\n            left += 1\n    return s",
    "prefix_sum": "def prefix(a):\n    p = [0]\n    for x in range(1, len(a)):\n        p[x] = p[x - 1] + a[x]\n    return p",
    "binary_search_standard": "def find(a, t):\n    left, right = 0, len(a) - 1\n    while left <= right:\n        mid = (left + right) // 2\n        if a[mid] == t:\n            return mid\n        if a[mid] < t:\n            left = mid + 1\n        else:\n            right = mid - 1\n    return -1",
    "binary_search_answer": "def least(n):\n    lo, hi = 1, n\n    while lo < hi:\n        mid = (lo + hi) // 2\n        if feasible(mid):\n            hi = mid\n        else:\n            lo = mid + 1\n    return lo",
    "heap_top_k": "import heapq\ndef top(a, k):\n    h = []\n    for x in a:\n        heapq.heappush(h, x)\n        if len(h) > k:\n            heapq.heappop(h)\n    return h",
    "monotonic_stack": "def warmer(t):\n    stack = []\n    out = [0] * len(t)\n    for i in range(len(t)):\n        while stack and t[stack[-1]] < t[i]:\n            j = stack.pop()\n            out[j] = i - j\n        stack.append(i)\n    return out",
    "monotonic_deque": "from collections import deque\ndef maxima(a, k):\n    q = deque()\n    out = []\n    for i in range(len(a)):\n        while q and a[q[-1]] < a[i]:\n            q.pop()\n        q.append(i)\n        if q[0] <= i - k:\n            q.popleft()\n        out.append(a[q[0]])\n    return out",
    "fast_slow_pointers": "def cycle(head):\n    slow = fast = head\n    while fast and fast.next:\n        slow = slow.next\n        fast = fast.next.next\n        if slow == fast:\n            return True\n    return False",
    "linked_list_reversal": "def reverse(head):\n    prev = None\n    cur = head\n    while cur:\n        nxt = cur.next\n        cur.next = prev\n        prev = cur\n        cur = nxt\n    return prev",
    "dfs_recursive": "def depth(root):\n    if not root:\n        return 0\n    return 1 + max(depth(root.left), depth(root.right))",
    "dfs_iterative": "def visit(graph, s):\n    stack = [s]\n    seen = set()\n    while stack:\n        n = stack.pop()\n        if n in seen:\n            continue\n        seen.add(n)\n        for m in graph[n]:\n            stack.append(m)\n    return seen",
    "bfs_level_order": "from collections import deque\ndef levels(root):\n    q = deque([root])\n    out = []\n    while q:\n        row = []\n        for _ in range(len(q)):\n            n = q.popleft()\n            row.append(n.val)\n            if n.left:\n                q.append(n.left)\n        out.append(row)\n    return out",
    "bfs_shortest_path": "from collections import deque\ndef path(graph, s, t):\n    q = deque([s])\n    dist = {s: 0}\n    visited = set()\n    while q:\n        n = q.popleft()\n        for m in graph[n]:\n            if m not in visited:\n                visited.add(m)\n                dist[m] = dist[n] + 1\n                q.append(m)\n    return dist[t]",
    "binary_search_tree": "def search(root, v):\n    if root is None or root.val == v:\n        return root\n    if v < root.val:\n        return search(root.left, v)\n    return search(root.right, v)",
    "topological_sort": "from collections import deque\ndef order(n, edges):\n    indegree = [0] * n\n    for a, b in edges:\n        indegree[b] += 1\n    q = deque()\n    for i in range(n):\n        if indegree[i] == 0:\n            q.append(i)\n    while q:\n        i = q.popleft()\n        for j in edges[i]:\n            indegree[j] -= 1\n            if indegree[j] == 0:\n                q.append(j)",
    "union_find": "class Sets:\n    def __init__(self, n):\n        self.parent = list(range(n))\n        self.rank = [0] * n\n    def find(self, x):\n        if self.parent[x] != x:\n            self.parent[x] = self.find(self.parent[x])\n        return self.parent[x]\n    def union(self, a, b):\n        self.parent[self.find(a)] = self.find(b)",
    "binary_search_rotated": "def find(a, t):\n    left, right = 0, len(a) - 1\n    while left <= right:\n        mid = (left + right) // 2\n        if a[mid] == t:\n            return mid\n        if a[left] <= a[mid]:\n            if a[left] <= t < a[mid]:\n                right = mid - 1\n            else:\n                left = mid + 1\n        else:\n            left = mid + 1\n    return -1",
    "greedy_local": "def profit(prices):\n    best = 0\n    low = prices[0]\n    for price in prices:\n        if price < low:\n            low = price\n        best = max(best, price - low)\n    return best",
    "greedy_interval": "def merge(items):\n    items.sort(key=lambda x: x[0])\n    out = [items[0]]\n    for s in items:\n        if s[0] <= out[-1][1]:\n            out[-1][1] = max(out[-1][1], s[1])\n        else:\n            out.append(s)\n    return out",
    "backtracking_subset": "def subsets(nums):\n    res = []\n    def go(i, path):\n        res.append(path[:])\n        for j in range(i, len(nums)):\n            path.append(nums[j])\n            go(j + 1, path)\n            path.pop()\n    go(0, [])\n    return res",
    "backtracking_permutation": "def permute(nums):\n    res = []\n    def go(k):\n        if k == len(nums):\n            res.append(nums[:])\n        for i in range(k, len(nums)):\n            nums[k], nums[i] = nums[i], nums[k]\n            go(k + 1)\n            nums[k], nums[i] = nums[i], nums[k]\n    go(0)\n    return res",
    "dp_1d_forward": "def stairs(n):\n    dp = [0] * (n + 1)\n    dp[0] = 1\n    dp[1] = 1\n    for i in range(2, n + 1):\n        dp[i] = dp[i - 1] + dp[i - 2]\n    return dp[n]",
    "dp_state_machine": "def trade(prices):\n    hold = -prices[0]\n    cash = 0\n    for p in prices:\n        hold = max(hold, cash - p)\n        cash = max(cash, hold + p)\n    return max(hold, cash)",
    "dp_1d_sequence": "def lis(a):\n    dp = [1] * len(a)\n    for i in range(len(a)):\n        for j in range(i):\n            if a[j] < a[i]:\n                dp[i] = max(dp[i], dp[j] + 1)\n    return max(dp)",
    "dp_2d_grid": "def paths(m, n):\n    dp = [[1] * n for _ in range(m)]\n    for i in range(1, m):\n        for j in range(1, n):\n            dp[i][j] = dp[i - 1][j] + dp[i][j - 1]\n    return dp[m - 1][n - 1]",
    "dp_2d_string": "def lcs(s, t):\n    dp = [[0] * (len(t) + 1) for _ in range(len(s) + 1)]\n    for i in range(1, len(s) + 1):\n        for j in range(1, len(t) + 1):\n            if s[i - 1] == t[j - 1]:\n                dp[i][j] = dp[i - 1][j - 1] + 1\n            else:\n                dp[i][j] = max(dp[i - 1][j], dp[i][j - 1])\n    return dp[-1][-1]",
    "dp_knapsack": "def fill(w, v, cap):\n    dp = [0] * (cap + 1)\n    for i in range(len(w)):\n        for c in range(cap, 0, -1):\n            if w[i] <= c:\n                dp[c] = max(dp[c], dp[c - w[i]] + v[i])\n    return dp[cap]",
    "dp_interval": "def burst(a):\n    n = len(a)\n    dp = [[0] * n for _ in range(n)]\n    for length in range(2, n):\n        for i in range(n - length):\n            j = i + length\n            for k in range(i + 1, j):\n                dp[i][j] = max(dp[i][j], dp[i][k] + dp[k][j] + a[i] * a[k])\n    return dp[0][n - 1]",
}
PLAIN = {
    "constant": "def f():\n    return 1",
    "formula": "def area(r):\n    return 3 * r * r",
    "broken": "def f(:\n    pass",
    "unsafe": "x = eval('1')",
    "imports": "import subprocess",
    "blank": "   ",
    "java": "public class A { int x; }",
}
