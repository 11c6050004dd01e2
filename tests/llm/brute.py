from collections import defaultdict



def brute_words(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = (text or "").translate(low)
    for c in "\x09\x0a\x0b\x0c\x0d":
        out = out.replace(c, " ")
    return [w for w in out.split(" ") if w]


def shingle_set(text, size=5):
    w = brute_words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def link_components(rows, share=85):
    """doc_id: (set size, component, kept), by comparing all pairs that share a shingle."""
    sets = {r.doc_id: shingle_set(r.text) for r in rows if r.doc_id is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = defaultdict(list)
    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for k in having[s]:
                shared[k] += 1
            having[s].append(i)
        for k, n in shared.items():
            if 100 * n >= share * (len(sets[i]) + len(sets[k]) - n):
                a, b = find(i), find(k)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def window_words(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = "".join(c if c.isascii() and (c.islower() or c.isdigit()) or not c.isascii() else " " for c in (text or "").translate(low))
    return [w for w in out.split(" ") if w]


def contaminated(text, items, size=10):
    """n_words, hit word places and ids of items with a window in the text."""
    w, hit, found = window_words(text), set(), set()
    for item_id, body in items:
        b = window_words(body)
        n = min(size, len(b))
        for s in range(len(b) - n + 1) if n else ():
            for k in range(len(w) - n + 1):
                if w[k : k + n] == b[s : s + n]:
                    hit |= set(range(k, k + n))
                    found.add(item_id)
    return len(w), hit, found


