"""Labelled code for each pattern: what the evidence in it adds up to, or 0 where a condition is missed."""

from __future__ import annotations

_HALVES = "while lo <= hi:\n    mid = (lo + hi) // 2\n    "
_GRID = "def f(m, n):\n    dp = [[0] * n for _ in range(m)]\n    for i in range(m):\n        for j in range(n):\n            "
_PAIR = "def f(s, t):\n    dp = [[0] * 9 for _ in range(9)]\n    "

LABELLED: dict[str, list[tuple[float, str]]] = {
    "brute_force": [
        (0.75, "for i in range(3):\n    for j in range(3):\n        print(i, j)"),
        (0.35, "while a:\n    while b:\n        b -= 1"),
        (0.2, "def f(n):\n    return f(n - 1) + f(n - 2)"),
        (0.25, "def f(a):\n    for x in a:\n        f(x)"),
        (0, "for i in range(9):\n    if a[i] > 0:\n        print(i)"),
        (0, "for i in a:\n    if i:\n        for j in b:\n            print(j)"),
        (0, "def f(n):\n    return f(n - 1)"),
    ],
    "array_traversal": [
        (0.65, "for x in nums:\n    print(x)"),
        (0.7, "for i in range(9):\n    print(a[i])"),
        (1, "for i, x in enumerate(a):\n    b[i] = x"),
        (0, "for x in f(a):\n    print(a[x])"),
        (0, "for x in nums:\n    print(1)"),
        (0, "print(a[0])"),
        (0, "while i < 3:\n    a[i] = 0"),
    ],
    "sorting": [
        (0.4, "a.sort()"),
        (0.6, "b = sorted(a, key=len)"),
        (0.2, "m = max(a, key=len)"),
        (0, "sort = 1\nb = reversed(a)"),
        (0, "a.sorted()"),
    ],
    "hash_map_lookup": [
        (0.8, "d = {}\nfor x in a:\n    if x in d:\n        print(x)"),
        (0.75, "s = set()\nr = [x for x in a if x not in s]"),
        (0.9, "d = {k: 1 for k in a}\nwhile 1 in d:\n    pass"),
        (0, "d = {}\nfor x in a:\n    d[x] = 1"),
        (0, "d = {}\nprint(1 in d)"),
        (0, "d = {1: 2}\nfor x in a:\n    print(x in d)"),
        (0, "self.d = {}\nfor x in a:\n    print(x in self.d)"),
    ],
    "hash_map_frequency": [
        (0.55, "for c in s:\n    d[c] = d.get(c, 0) + 1"),
        (0.5, "from collections import Counter\nc = Counter(s)"),
        (0.4, "from collections import defaultdict\nfor c in s:\n    print(c)"),
        (0, "from collections import Counter\nc = Counter()"),
        (0, "d = {}\nfor c in s:\n    d[c] += 1"),
        (0, "for c in s:\n    d[c] = e.get(c, 0) + 1"),
        (0, "for c in s:\n    d[c] = 1 + d.get(c, 0)"),
    ],
    "two_pointers_same": [
        (0.4, "while f < n:\n    s += 1\n    f += 2"),
        (0.3, "while p and p.next:\n    q = q.next\n    p = p.next.next"),
        (0.4, "while f > 0:\n    s += 1\n    f += -2"),
        (0, "while True:\n    i = i + 1\n    j = j + 2"),
        (0, "while f < n:\n    s += 1\n    f += 1"),
        (0, "while f < n:\n    s += 2\n    f += 3"),
        (0, "while f < n:\n    s -= 1\n    f -= 2"),
        (0, "for i in a:\n    s += 1\n    f += 2"),
        (0, "while f < n:\n    try:\n        s += 1\n    finally:\n        f += 2"),
    ],
    "two_pointers_opposite": [
        (0.9, "while i < j:\n    i += 1\n    j -= 1"),
        (0.65, "while i <= len(a):\n    if a[i]:\n        i += 1\n    else:\n        j -= 1"),
        (0.9, "while i < j:\n    if x:\n        i += 1\n    elif y:\n        j -= 1"),
        (0, "while i > j:\n    i += 1\n    j -= 1"),
        (0, "while i < j and x:\n    i += 1\n    j -= 1"),
        (0, "while i < j:\n    i += 1\n    j += 1"),
        (0, "while i < 9:\n    i += 1\n    j -= 1"),
        (0, "while i < j:\n    for x in a:\n        i += 1\n        j -= 1"),
        (0, "while i < j:\n    i = i + 1\n    j = j - 1"),
    ],
    "sliding_window_fixed": [
        (0.85, "for i in range(9):\n    s += a[i]\n    if i >= k:\n        s -= a[i - k]"),
        (0.85, "for i in range(9):\n    if k <= i + 1:\n        w[a[i]] -= 1"),
        (0, "for i in range(9):\n    if a[i] > 0:\n        s -= 1"),
        (0, "for i in range(9):\n    if i >= k and x:\n        s -= 1"),
        (0, "for i in range(9):\n    if i >= k:\n        for j in b:\n            s -= 1"),
        (0, "for i in range(9):\n    if i >= k:\n        s += 1"),
        (0, "for i, x in enumerate(a):\n    if i >= k:\n        s -= 1"),
        (0, "for i in range(9):\n    if x:\n        y = 1\n    if i >= k:\n        s -= 1"),
    ],
    "sliding_window_variable": [
        (0.9, "p = 0\nfor r in range(9):\n    while s > t:\n        s -= a[p]\n        p += 1"),
        (0.6, "left = 0\nfor right in range(9):\n    while left < right:\n        left += 1"),
        (0.9, "left = 0\nfor right in range(9):\n    while len(w) > 3:\n        left += 1"),
        (0.55, "left = 0\nfor i, c in enumerate(s):\n    if c in d:\n        left = d[c]"),
        (0, "for r in range(9):\n    while s > t:\n        p += 1"),
        (0, "p = 1\nfor r in range(9):\n    while s > t:\n        p += 1"),
        (0, "p = 0\nfor r in range(9):\n    while s > t:\n        p += 2"),
        (0, "left = 0\nfor c in s:\n    left = c"),
        (0, "p = 0\nq = 0\nfor r in range(9):\n    while s > t:\n        q += 1"),
    ],
    "prefix_sum": [
        (0.7, "for i in range(1, 9):\n    p[i] = p[i - 1] + a[i]"),
        (0.7, "for x in a:\n    p.append(p[-1] + x)"),
        (1, "for x in a:\n    s += x\n    seen[s] = 1"),
        (0.3, "for x in a:\n    s += x\n    if s - k in seen:\n        n = 1"),
        (0, "for x in a:\n    s += x"),
        (0, "for i in range(9):\n    p[i] = a"),
        (0, "while i < 9:\n    p[i] = p[i - 1] + a[i]"),
        (0, "for i in range(9):\n    p[i] = x + p[i - 1]"),
        (0, "for i, x in enumerate(a):\n    p[i] = p[i - 1] + x"),
    ],
    "binary_search_standard": [
        (1, _HALVES + "if a[mid] < t:\n        lo = mid + 1\n    else:\n        hi = mid - 1"),
        (1, "while lo < hi:\n    m = lo + (hi - lo) // 2\n    if a[m] < t:\n        lo = m + 1\n    else:\n        hi = m"),
        (0, "while x <= y:\n    mid = (x + y) // 2\n    if a[mid] < t:\n        lo = mid + 1"),
        (0, _HALVES + "lo = mid + 1"),
        (0, "while lo <= hi:\n    c = (lo + hi) // 2\n    if a[c] < t:\n        lo = c + 1\n    else:\n        hi = c - 1"),
        (0, _HALVES + "if ok(mid):\n        lo = mid + 1"),
        (0, _HALVES + "if a[mid]:\n        lo = mid"),
        (0, "while lo <= hi:\n    mid = (lo + hi) >> 1\n    if a[mid]:\n        lo = mid + 1"),
    ],
    "binary_search_answer": [
        (1, _HALVES + "if ok(mid):\n        hi = mid\n    else:\n        lo = mid + 1"),
        (0.9, _HALVES + "if x or ok(a, mid):\n        break"),
        (0.9, _HALVES + "if not ok(mid):\n        lo = x"),
        (0, _HALVES + "if a[mid] < t:\n        lo = mid + 1"),
        (0, _HALVES + "if ok(mid) == 1:\n        hi = mid"),
        (0, "while lo < hi:\n    mid = lo + (hi - lo) // 2\n    if ok(mid):\n        hi = mid"),
        (0, "while lo != hi:\n    mid = (lo + hi) // 2\n    if ok(mid):\n        hi = mid"),
    ],
    "heap_top_k": [
        (0.35, "heapq.heappush(h, x)"),
        (0.6, "heappop(h)\nheapify(h)"),
        (0.25, "import heapq\nb = heapq.nlargest(3, a)"),
        (0.35, "a.b.heappush(x)"),
        (0, "hq.heappush(h, x)"),
        (0, "import heapq"),
        (0, "h = heapq.merge(a, b)"),
    ],
    "monotonic_stack": [
        (0.95, "s = []\nfor i in a:\n    while s and s[-1] < i:\n        s.pop()\n    s.append(i)"),
        (0.95, "s = list()\nfor i in a:\n    while s:\n        s.pop()\n    s.append(i)"),
        (0, "s = [0]\nfor i in a:\n    while s and s[-1] < i:\n        s.pop()\n    s.append(i)"),
        (0, "s = []\nfor i in a:\n    while x < i:\n        s.pop()\n    s.append(i)"),
        (0, "s = []\nfor i in a:\n    while s and s[-1] < i:\n        s.pop()"),
        (0, "s = []\nfor i in a:\n    while s and s[-1] < i:\n        break\n    s.append(i)"),
        (0, "s = []\nfor i in a:\n    if s and s[-1] < i:\n        s.pop()\n    s.append(i)"),
    ],
    "monotonic_deque": [
        (0.75, "q = deque()\nfor i in a:\n    while q and q[-1] < i:\n        q.pop()\n    q.append(i)"),
        (1, "q = deque()\nfor i in a:\n    while q and q[-1] < i:\n        q.pop()\n    q.append(i)\n    if q[0] < 3:\n        q.popleft()"),
        (0, "q = collections.deque()\nfor i in a:\n    while q:\n        q.pop()\n    q.append(i)"),
        (0, "q = deque([], 3)\nfor i in a:\n    while q:\n        q.pop()\n    q.append(i)"),
        (0, "q = []\nfor i in a:\n    while q:\n        q.pop()\n    q.append(i)"),
        (0, "q = deque()\nfor i in a:\n    while q:\n        q.pop()"),
    ],
    "fast_slow_pointers": [
        (0.6, "while p and p.next:\n    q = q.next\n    p = p.next.next"),
        (1, "slow = fast = head\nwhile fast and fast.next:\n    slow = slow.next\n    fast = fast.next.next\n    if slow == fast:\n        break"),
        (0.6, "while slow != fast:\n    slow = a[slow]\n    fast = a[a[fast]]"),
        (0, "slow = fast = 0"),
        (0, "while p:\n    p = p.next\n    q = q.next"),
        (0, "while p:\n    q = p.next\n    p = q.next.next"),
        (0, "if slow == fast:\n    pass"),
        (0, "while fast:\n    if slow < fast:\n        fast = 0"),
    ],
    "linked_list_reversal": [
        (1, "while curr:\n    nxt = curr.next\n    curr.next = prev\n    prev = curr\n    curr = nxt"),
        (0.8, "while c:\n    n = c.next\n    c.next = p\n    p = c\n    c = n"),
        (1, "def f(h):\n    p = f(h.next)\n    h.next.next = h\n    h.next = None\n    return p"),
        (0, "while curr:\n    prev = curr\n    curr = curr.next"),
        (0, "while c:\n    c.next = p\n    c = x"),
        (0, "def f(h):\n    h.next.next = g"),
        (0, "for c in a:\n    c.next = prev\n    prev = c"),
    ],
    "dfs_recursive": [
        (0.6, "def d(n):\n    d(n.left)"),
        (0.65, "def d(graph, u):\n    for v in graph[u]:\n        d(graph, v)"),
        (0.55, "def d(u):\n    if u in visited:\n        return\n    d(u + 2)"),
        (0.6, "def d(i, j):\n    d(i + 1, j)\n    d(i - 1, j)\n    d(i, j + 1)"),
        (0.85, "def d(a):\n    if a is None:\n        return\n    for n in a.kids:\n        d(n)"),
        (0, "def d(n):\n    return d(n - 1)"),
        (0, "def d(g, u, seen):\n    for v in g[u]:\n        d(g, v, seen)"),
        (0, "def d(n):\n    if not n:\n        return\n    d(n)"),
        (0, "def d(i, j):\n    d(i + 1, j)\n    d(i - 1, j)"),
        (0, "def e(n):\n    d(n.left)"),
    ],
    "dfs_iterative": [
        (0.6, "s = [1]\nwhile s:\n    n = s.pop()\n    s.append(n)"),
        (0.9, "s = [1]\nwhile s:\n    n = s.pop()\n    for c in g[n]:\n        s.append(c)"),
        (0.55, "s = [1]\nwhile s:\n    n = s.pop()\n    seen.add(n)"),
        (0.65, "s = [1]\nwhile s:\n    n = s.pop()\n    for child in n:\n        print(child)"),
        (0, "s = [1]\nwhile s:\n    s.pop()"),
        (0, "while s:\n    s.pop()\n    s.append(1)"),
        (0, "s = [1]\nwhile s and s[-1] < 3:\n    s.pop()\n    s.append(2)"),
        (0, "s = [1]\nwhile x:\n    while s and s[-1] < x:\n        s.pop()\n    s.append(x)"),
    ],
    "bfs_level_order": [
        (0.65, "while q:\n    n = q.popleft()\n    q.append(n.left)"),
        (1, "from collections import deque\nwhile q:\n    size = len(q)\n    for _ in range(size):\n        n = q.popleft()\n        q.extend(n.kids)"),
        (0.65, "while q:\n    n = q.pop(0)\n    q.append(n)"),
        (0, "while q:\n    n = q.pop()\n    q.append(n)"),
        (0, "while q:\n    n = q.popleft()"),
        (0, "while q:\n    n = q.popleft()\n    q.append(n)\n    steps += 1"),
        (0, "while q:\n    n = q.popleft()\n    seen.add(n)\n    q.append(n)"),
    ],
    "bfs_shortest_path": [
        (0.55, "while q:\n    n = q.popleft()\n    dist += 1"),
        (0.75, "while q:\n    n = q.popleft()\n    visited.add(n)\n    for m in graph[n]:\n        q.append(m)"),
        (1, "while q:\n    level = 0\n    for _ in range(len(q)):\n        q.popleft()"),
        (0.5, "while q:\n    n = q.popleft()\n    seen = n"),
        (0, "while q:\n    n = q.popleft()\n    q.append(n)"),
        (0, "while q:\n    n = q.pop()\n    dist += 1"),
        (0, "while q:\n    n = q.popleft()\n    dist *= 2"),
        (0, "while q:\n    n = q.popleft()\n    dist = n"),
    ],
    "binary_search_tree": [
        (0.55, "def go(n, x):\n    if x < n.val:\n        return go(n.left, x)"),
        (0.85, "def insert(n, key):\n    if key > n:\n        insert(n.right, key)"),
        (0.8, "def ok(n, low, high):\n    if not (low < n.val < high):\n        return False\n    if n.val < 0:\n        return ok(n.left, low, high)"),
        (0, "def go(n, x):\n    if x == n.val:\n        return go(n.left, x)"),
        (0, "def go(n, x):\n    if x < n.val:\n        return go(n, x)"),
        (0, "def go(n, x):\n    while x < n.val:\n        go(n.left, x)"),
        (0, "def search(n, x):\n    if x < n.size:\n        search(n.left, x)"),
    ],
    "topological_sort": [
        (0.6, "indegree = [0] * 3\nq = [i for i in range(3) if indegree[i] == 0]"),
        (0.5, "degree[b] += 1\nif degree[b] == 0:\n    q.append(b)"),
        (0.55, "degree[b] = degree[b] - 1\nq = deque([i for i in a if 0 == degree[i]])"),
        (0, "indegree = [0] * 3"),
        (0, "q = [i for i in a if indegree[i] == 0]"),
        (0, "degree[b] += 1\nif degree[b] > 0:\n    q.append(b)"),
        (0, "degree[b] -= 2\nif degree[b] == 0:\n    q.append(b)"),
        (0, "rank[b] += 1\nif rank[b] == 0:\n    q.append(b)"),
        (0, "indegree = {}\nq = [i for i in a if indegree[i] == 0]"),
    ],
    "union_find": [
        (0.55, "class U:\n    def __init__(self, n):\n        self.parent = list(range(n))\n    def find(self, x):\n        if self.parent[x] != x:\n            self.parent[x] = self.find(self.parent[x])\n        return self.parent[x]"),
        (0.55, "class U:\n    def __init__(self, n):\n        self.parent = [0]\n    def union(self, a, b):\n        pass"),
        (1, "class U:\n    def __init__(self, n):\n        self.parent = [i for i in range(n)]\n        self.rank = [0] * n\n    def find(self, x):\n        while x:\n            self.parent[x] = x\n"
            "    def unite(self, a, b):\n        if self.rank[a] < self.rank[b]:\n            pass\n    def connected(self, a, b):\n        return self.find(a) == self.find(b)"),
        (0, "parent = list(range(9))\ndef find(x):\n    parent[x] = find(x)"),
        (0, "class U:\n    def __init__(self, n):\n        self.parent = n\n    def union(self, a, b):\n        pass"),
        (0, "class U:\n    def __init__(self, n):\n        self.parent = [n]\n    def find(self, x):\n        while x:\n            x = 1"),
        (0, "class U:\n    def __init__(self, n):\n        self.parents = [n]\n    def union(self):\n        pass"),
    ],
    "binary_search_rotated": [
        (1, "while left <= right:\n    mid = (left + right) // 2\n    if nums[left] <= nums[mid]:\n        if nums[left] <= target < nums[mid]:\n            right = mid - 1"),
        (0.8, "while l < r:\n    m = (l + r) // 2\n    if a[l] < a[m] and a[m] > t:\n        r = m"),
        (0, "while left <= right:\n    mid = (left + right) // 2\n    if nums[mid] < target:\n        left = mid + 1"),
        (0, "while left < right:\n    mid = (left + right) // 2\n    if nums[mid] > nums[right]:\n        left = mid + 1"),
        (0, "while left <= right:\n    mid = (left + right) // 2\n    if bib[left] <= bib[mid] and bib[mid] == target:\n        right = mid - 1"),
        (0, "while l < r:\n    m = (l + r) // 2\n    if a[l] < a[m] and a[m] > t:\n        r = m\n    if ok(m):\n        break"),
    ],
    "greedy_local": [
        (0.35, "def f(a):\n    return max(a)"),
        (0.35, "def f(a):\n    best = 0\n    for p in a:\n        best += p"),
        (0.55, "def f(a):\n    i = 0\n    while i < 3:\n        if curr > 0:\n            x = 1\n        i += 1"),
        (0.35, "def f(p):\n    profit = a - p"),
        (0, "m = max(a)"),
        (0, "def f(a):\n    if curr > 0:\n        x = 1"),
        (0, "def f(a):\n    i = 0\n    while i < 3:\n        i += 1"),
        (0, "def f(a):\n    best = 0\n    return best"),
        (0, "def f(a):\n    while x:\n        if curr > 0:\n            y = 1\n        z += 1"),
    ],
    "greedy_interval": [
        (0.8, "def f(v):\n    v.sort(key=lambda x: x[1])\n    for s, e in v:\n        if s >= last:\n            count += 1"),
        (0.85, "def f(v):\n    v = sorted(v, key=lambda x: x.start)\n    if v[0][1] < 3:\n        v[0][1] = 4"),
        (0, "def f(v):\n    v.sort()\n    if v[0][1] < 3:\n        v[0][1] = 4"),
        (0, "def f(v):\n    v.sort(key=lambda x: x[2])\n    if v[0][1] < 3:\n        pass"),
        (0, "def f(v):\n    v.sort(key=lambda x: x[0])\n    return v"),
        (0, "def f(v):\n    v.sort(key=first)\n    if v[0][1] < 3:\n        pass"),
        (0, "def f(v):\n    v.sort(key=lambda x: x[0])\n    if x < y:\n        x = y"),
    ],
    "backtracking_subset": [
        (0.8, "def go(i):\n    path.append(i)\n    go(i + 1)\n    path.pop()"),
        (0.55, "def go(i):\n    x -= 1\n    go(i)\n    go(i + 1)"),
        (0, "def go(i):\n    go(i)\n    go(i + 1)"),
        (0, "def go(i):\n    path.append(i)\n    path.pop()"),
        (0, "def go(i):\n    path.append(i)\n    go(i)\n    x = path.pop()"),
        (0, "def go(i):\n    path.append(i)\n    go(i)"),
    ],
    "backtracking_permutation": [
        (0.55, "def go(k):\n    for i in range(k):\n        a[k], a[i] = a[i], a[k]\n        go(k + 1)"),
        (0.55, "def go(k):\n    if used[k]:\n        return\n    path.append(k)\n    go(k)"),
        (0, "def go(k):\n    for i in b:\n        a[k], a[i] = a[i], a[k]\n        go(k)"),
        (0, "def go(k):\n    if used[k]:\n        go(k)"),
        (0, "def go(k):\n    path.append(k)\n    go(k)"),
        (0, "def go(k):\n    for i in range(k):\n        a[k], a[i] = a[i], a[k]"),
        (0, "def go(k):\n    for i in range(k):\n        if i:\n            a[k], a[i] = a[i], a[k]\n        go(k)"),
    ],
    "dp_1d_forward": [
        (1, "def f(n):\n    dp = [0] * n\n    for i in range(2, n):\n        dp[i] = dp[i - 1] + dp[i - 2]\n    return dp[-1]"),
        (0.7, "@cache\ndef f(n):\n    if n <= 1:\n        return 1\n    return f(n - 1) + f(n - 2)"),
        (0.95, "def f(n):\n    dp = [0] * n\n    for i in range(n):\n        dp[i] = max(x, dp[i - 1])"),
        (0.95, "def f(n):\n    dp = [0] * n\n    for i in a:\n        for j in b:\n            dp[i] = dp[i - 1] + dp[i - 2]"),
        (0, "def f(n):\n    dp = [0] * n\n    for i in range(n):\n        dp[i] = dp[i - 1] + a[i]"),
        (0, "def f(n):\n    dp = x\n    for i in range(n):\n        dp[i] = dp[i - 1] + dp[i - 2]"),
        (0, "def f(n):\n    if n <= 1:\n        return 1\n    return f(n - 1)"),
        (0, "def f(n):\n    t = [0] * n\n    for i in range(2, n):\n        t[i] = t[i - 1] + t[i - 2]"),
    ],
    "dp_state_machine": [
        (1, "def f(a):\n    for p in a:\n        hold = max(hold, cash - p)\n        cash = max(cash, hold + p)\n    return max(hold, cash)"),
        (0.8, "def f(a):\n    for p in a:\n        hold = max(hold, cash - p)\n        cash = max(cash, hold + p)"),
        (0.8, "def f(a):\n    dp = [0] * 2\n    while a:\n        dp[0] = max(dp[0], dp[1] + 1)\n        dp[1] = max(dp[1], 2)"),
        (0, "def f(a):\n    for p in a:\n        best = max(best, p - low)\n        low = min(low, p)"),
        (0, "def f(a):\n    for p in a:\n        s = max(s, p)"),
        (0, "def f(a):\n    while a:\n        x = max(x, y + 1)\n        y = max(y, x)"),
        (0, "def f(a):\n    for q in a:\n        for p in q:\n            x = max(x, y + 1)\n            y = max(y, x)"),
    ],
    "dp_1d_sequence": [
        (1, "def f(a):\n    dp = [1] * 9\n    for i in a:\n        for j in a:\n            dp[i] = max(dp[i], dp[j] + 1)\n    return max(dp)"),
        (0.7, "def f(a):\n    for i in a:\n        for j in a:\n            dp[i] = dp[j]\n    return max(dp)"),
        (0, "def f(a):\n    dp = [1] * 9\n    for i in a:\n        dp[i] = dp[j]"),
        (0, "def f(a):\n    dp = [1] * 9\n    for i in a:\n        for x in a:\n            dp[i] = dp[x]"),
        (0, "def f(a):\n    for i in a:\n        for j in a:\n            dp[i] = dp[j]"),
        (0, "def f(a):\n    t = [1] * 9\n    for i in a:\n        for j in a:\n            t[i] = max(t[i], t[j] + 1)"),
    ],
    "dp_2d_grid": [
        (0.8, _GRID + "dp[i][j] = dp[i - 1][j] + dp[i][j - 1]"),
        (1, "def f(g):\n    for r in g:\n        for c in g:\n            if r == 0:\n                x = 1\n            dp[r][c] = min(dp[r - 1][c], dp[r][c - 1])\n    return dp[-1][-1]"),
        (0, _GRID + "if s[i] == t[j]:\n                dp[i][j] = dp[i - 1][j - 1]"),
        (0, "def f(m, n):\n    dp = [[0] * n for _ in range(m)]\n    for i in range(m):\n        dp[i][0] = dp[i - 1][0]"),
        (0, "def f(m, n):\n    for i in range(m):\n        for j in range(n):\n            dp[i][j] = dp[i - 1][j]"),
        (0, _GRID + "dp[i][j] = dp[i + 1][j]"),
    ],
    "dp_2d_string": [
        (1, _PAIR + "for i in range(9):\n        for j in range(9):\n            if s[i] == t[j]:\n                dp[i][j] = dp[i - 1][j - 1]"),
        (0.75, "def f(s, t):\n    if s[0] == t[0]:\n        return max(dp[x - 1][y], 1)"),
        (0, _PAIR + "if s[0] == 1:\n        dp[i][j] = dp[i - 1][j]"),
        (0, _PAIR + "if u[0] == v[0]:\n        dp[i][j] = dp[i - 1][j]"),
        (0, _PAIR + "if s[0] != t[0]:\n        dp[i][j] = dp[i - 1][j]"),
        (0, _PAIR + "if s[0] == t[0]:\n        dp[i][j] = dp[i + 1][j]"),
    ],
    "dp_knapsack": [
        (0.9, "def f(w, cap):\n    dp = [0] * cap\n    for i in range(9):\n        for c in range(cap):\n            if w[i] <= c:\n                dp[c] = max(dp[c], dp[c - w[i]] + 1)\n    return dp[cap]"),
        (0.8, "def f(w, c):\n    dp = [[0] for _ in range(9)]\n    if c >= w[0]:\n        dp[0] = x or dp[1]"),
        (0, "def f(w, cap):\n    for i in range(9):\n        for c in range(cap):\n            dp[c] = max(dp[c], dp[c - w[i]] + 1)"),
        (0, "def f(w, cap):\n    for i in a:\n        for c in a:\n            if w[i] == c:\n                dp[c] = max(dp[c], 1)"),
        (0, "def f(w, cap):\n    for i in a:\n        for c in a:\n            if w[i] <= c:\n                dp[c] = 1"),
        (0, "def f(w, cap):\n    if w[0] <= cap:\n        dp[0] = max(dp[1], 2)"),
    ],
    "dp_interval": [
        (1, "def f(n):\n    dp = [[0] * n for _ in range(n)]\n    for length in range(n):\n        for i in range(n):\n            j = i + length\n            dp[i][j] = min(dp[i][j], dp[i][k] + dp[k][j])"),
        (0.85, "def f(n):\n    dp = [[0] for _ in range(n)]\n    for x in range(2, n):\n        print(dp[0][1])"),
        (0, "def f(n):\n    dp = [[0] for _ in range(n)]\n    for x in range(n):\n        print(dp[0][1])"),
        (0, "def f(n):\n    for gap in range(n):\n        print(dp[0][1])"),
        (0, "def f(n):\n    dp = [[0] for _ in range(n)]\n    for a, b in range(2, n):\n        print(dp[0][1])"),
    ],
}

#: (pattern, expected confidence, code), in the order above.
ROWS = [(pattern, float(expected), code) for pattern, cases in LABELLED.items() for expected, code in cases]
