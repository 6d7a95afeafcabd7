"""Small sequential reference implementations used only by the tests."""

from __future__ import annotations

from collections import Counter


def seq_bpe(word_counts: dict[bytes, int], n_merges: int, min_freq: int = 2):
    """One merge at a time; ties by (left id, right id). Ids: byte + 1."""
    words = Counter()
    for w, c in word_counts.items():
        words[tuple(b + 1 for b in w)] += c
    merges, next_id = [], 257
    for _ in range(n_merges):
        pc = Counter()
        for w, c in words.items():
            for a, b in zip(w, w[1:]):
                pc[(a, b)] += c
        if not pc:
            break
        (a, b), c = min(pc.items(), key=lambda kv: (-kv[1], kv[0]))
        if c < min_freq:
            break
        merges.append((a, b, next_id, c))
        new = Counter()
        for w, cnt in words.items():
            out, i = [], 0
            while i < len(w):
                if i + 1 < len(w) and w[i] == a and w[i + 1] == b:
                    out.append(next_id)
                    i += 2
                else:
                    out.append(w[i])
                    i += 1
            new[tuple(out)] += cnt
        words, next_id = new, next_id + 1
    return merges
