"""Parts of operators 2 and 10 against plain recomputations: densities of random trees, all paths of small lattices."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

from calyx.llm import html_density, toxicity
from tests.llm.data import word


def random_tree(rng, depth=0):
    """[tag, part, ...] with strings as text and ("a", text) as links; paragraphs hold no blocks."""
    tag = "div" if depth < 3 and rng.random() < 0.6 else "p"
    parts = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if tag == "div" and kind < 0.6:
            parts.append(random_tree(rng, depth + 1))
        elif kind < 0.75:
            parts.append(("a", " ".join(word(rng, "en") for _ in range(rng.randint(1, 6)))))
        else:
            parts.append(" ".join(word(rng, "en") for _ in range(rng.randint(1, 25))))
    return [tag, *parts]


def written(node):
    if isinstance(node, str):
        return node
    if isinstance(node, tuple):
        return f"<a href='/x'>{node[1]}</a>"
    return f"<{node[0]}>" + "".join(map(written, node[1:])) + f"</{node[0]}>"


def plain_main_text(body):
    """Counts, densities, sums and the threshold by recursion over the nested lists."""
    nodes = []  # (node, parent) in page order

    def walk(node, parent):
        k = len(nodes)
        nodes.append((node, parent))
        for x in node[1:]:
            if isinstance(x, list):
                walk(x, k)

    walk(body, None)

    def count(node):  # characters, tags inside, characters and tags of links
        c = t = lc = lt = 0
        for x in node[1:]:
            if isinstance(x, str):
                c += len(x)
            elif isinstance(x, tuple):
                c, t, lc, lt = c + len(x[1]), t + 1, lc + len(x[1]), lt + 1
            else:
                a, b, d, e = count(x)
                c, t, lc, lt = c + a, t + b + 1, lc + d, lt + e
        return c, t, lc, lt

    total = count(body)
    if not total[0]:
        return ""
    ratio = total[2] / total[0]

    def density(node):
        c, t, lc, lt = count(node)
        if not c:
            return 0.0
        value = (c / max(lc, 1)) * (max(t, 1) / max(lt, 1))
        base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
        return max(0.0, c / max(t, 1) * math.log(max(value, 1.0)) / max(base, 1e-9)) if value > 1 else 0.0

    dens = [density(n) for n, _ in nodes]
    sums = []
    for k, (n, _) in enumerate(nodes):
        own = sum(len(x) if isinstance(x, str) else len(x[1]) for x in n[1:] if not isinstance(x, list))
        sums.append(dens[k] * own / max(count(n)[0], 1) + sum(dens[j] for j, (_, up) in enumerate(nodes) if up == k))
    best = max(range(len(nodes)), key=lambda k: (round(sums[k], 9), -k))
    path = [best]
    while nodes[path[-1]][1] is not None:
        path.append(nodes[path[-1]][1])
    limit = min(dens[k] for k in path)
    keep = {best}
    for k, (n, up) in enumerate(nodes):
        c, _, lc, _ = count(n)
        if k not in path and up in path and up != best and dens[k] >= limit and 2 * lc < c:
            keep.add(k)
    whole = set(keep)
    for k, (n, up) in enumerate(nodes):
        c, _, lc, _ = count(n)
        if up in whole:
            whole.add(k)
        if up in keep:
            keep.add(k)
        if k in keep and n[0] != "p" and 2 * lc > c and dens[k] < limit:
            keep.discard(k)
    if not any(k in keep and any(not isinstance(x, list) for x in n[1:]) for k, (n, _) in enumerate(nodes)):
        keep = whole
    lines, line = [], []

    def end():
        if line:
            lines.append(" ".join("".join(line).split()))
            line.clear()

    index = iter(range(len(nodes)))

    def read(node):
        k = next(index)
        end()
        for x in node[1:]:
            if isinstance(x, list):
                read(x)
            elif k in keep:
                line.append(x if isinstance(x, str) else x[1])
        end()

    read(body)
    return "\n".join(x for x in lines if x)


def test_densities_sums_and_threshold_decide_as_recomputed():
    rng = random.Random(6)
    parts = 0
    for _ in range(400):
        body = ["body", *(random_tree(rng) for _ in range(rng.randint(1, 4)))]
        want = plain_main_text(["html", body])  # the page itself is a node
        assert html_density.main_text(f"<html>{written(body)}</html>") == want, written(body)
        parts += want.count("\n") + 1 < written(body).count("</p>")
    assert parts > 50  # in many of them something is left out


def test_viterbi_finds_the_best_of_all_paths():
    rng = random.Random(7)
    counts = Counter(k for w in [word(rng, "en") for _ in range(300)] + ["idiot", "stupid"] * 20 for k in toxicity.trigrams(w) if w.isascii())
    model = toxicity.CharModel(counts)

    def paths(token):
        """(score, word) of every way through the lattice."""
        ways = []
        for c in token:
            own = [(x, toxicity.LOOK) for x in toxicity.LOOKS.get(c, "")] + ([(c, toxicity.SAME)] if c.isalpha() else [])
            ways.append([(x, cost, False) for x, cost in own] + [(x, cost + toxicity.AGAIN, True) for x, cost in own]
                        + ([("", toxicity.NONE, False)] if not c.isalpha() else []))
        for way in itertools.product(*ways):
            out, score = "", 0.0
            for x, cost, again in way:
                score += cost
                if again:
                    if not out.endswith(x):
                        break
                else:
                    out += x
            else:
                grams = toxicity.trigrams(out)
                yield score + sum(model.log(g[:2], g[2]) for g in grams), out

    for token in ["1d10t", "st00pid", "i-d-i", "iiidi", "$tup!d", "a@a", "th3", "...", "x", "éé1", "|o|"]:
        best = max(s for s, _ in paths(token))
        assert toxicity.restore(token, model) in {w for s, w in paths(token) if s > best - 1e-9}, token
