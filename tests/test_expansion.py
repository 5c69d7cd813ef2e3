"""Expansions under budgets against plain loops that take one paper after the other."""

import random

import pytest

from athenor.iterative.expansion import Budget, alternating_expansion, best_of_buckets, bucket_expansion
from athenor.iterative.traversal import adaptive_depth
from athenor.params import Params


def intro(n, p):
    quarter = int(n * p.intro_share)
    return min(max(quarter, 10) if n >= 10 else quarter, 40, p.intro_most)


def plain_buckets(edges, relevance, seeds, budget, p):
    refs, citing = {}, {}
    for s, d, pos, n in edges:
        if pos <= min(intro(n, p), budget.refs):
            refs.setdefault(s, []).append((pos, d))
        citing.setdefault(d, set()).add(s)
    seen, history, calls, out, table = set(seeds), [], 0, [], []

    def follow(paper):
        nonlocal calls
        calls += budget.calls_per_paper
        got = []
        for other in [d for _, d in sorted(refs.get(paper, []))] + sorted(citing.get(paper, ()))[: budget.cites]:
            if other in seen or other not in relevance:
                continue
            history.append(relevance[other])
            if relevance[other] >= budget.min_relevance:
                seen.add(other)
                got.append(other)
        return got

    def keep(bucket, parent, generation, got):
        mean = sum(relevance[x] for x in got) / len(got)
        table.append((bucket, parent, generation, len(got), round(mean, 9), mean < p.min_bucket_relevance))
        return (bucket, got, mean)

    root = [x for s in sorted(seeds) for x in follow(s)]
    place = 0
    for x in root:
        out.append((x, 0, None, place, relevance[x]))
        place += 1
    now = [keep(None, None, 0, root)] if root else []
    last, generation = adaptive_depth(len(root), budget.generations), 0
    while any(mean >= p.min_bucket_relevance for _, _, mean in now):
        if calls >= budget.calls:
            return out, table, "calls", calls
        tail = history[-p.drift_window :]
        if len(tail) >= p.drift_window and sum(r >= budget.min_relevance for r in tail) / len(tail) < p.drift_kill:
            return out, table, "drift", calls
        if generation >= last:
            return out, table, "generations", calls
        generation, place, after = generation + 1, 0, []
        for bucket, got, mean in now:
            if mean < p.min_bucket_relevance:
                continue
            for paper in got:
                if calls >= budget.calls:
                    break
                if new := follow(paper):
                    for x in new:
                        out.append((x, generation, paper, place, relevance[x]))
                        place += 1
                    after.append(keep(paper, bucket, generation, new))
        now = after
    return out, table, "exhausted", calls


def graph(rng, n, degree):
    edges = []
    for s in range(n):
        near = rng.sample(range(n), min(degree, n))
        edges += [(s, d, k + 1, len(near)) for k, d in enumerate(near) if d != s]
    return edges


CASES = {
    "exhausted": (60, 4, Budget(), Params(), 0.6),
    "calls": (200, 6, Budget(calls=31), Params(), 0.6),
    "generations": (120, 12, Budget(generations=1), Params(drift_kill=0.0), 0.5),
    "drift": (150, 12, Budget(min_relevance=0.97, generations=9), Params(min_bucket_relevance=0.0, drift_window=10, drift_kill=0.3), 0.6),
}


@pytest.mark.parametrize("stop", CASES)
def test_buckets_equal_the_plain_loop(spark, stop):
    n, degree, budget, p, high = CASES[stop]
    rng = random.Random(len(stop))
    edges = graph(rng, n, degree)
    relevance = {x: round(rng.random() * high, 3) for x in range(n) if x % 11}
    if stop == "drift":
        relevance = {x: 0.99 if x % 7 == 0 else 0.1 for x in relevance}
    seeds = [0, 3, 5]
    wanted, table, why, calls = plain_buckets(edges, relevance, seeds, budget, p)
    got = bucket_expansion(
        spark.createDataFrame(edges, "src int, dst int, ref_pos int, n_refs int").repartition(3), spark.createDataFrame(list(relevance.items()), "paper int, relevance double"),
        spark.createDataFrame([(s,) for s in (*seeds, 0)], "paper int"), budget, p,
    )
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.papers.collect()), key=key) == sorted(wanted, key=key)
    assert sorted(((r[0], r[1], r[2], r[3], round(r[4], 9), r[5]) for r in got.buckets.collect()), key=key) == sorted(table, key=key)
    assert (got.stopped, got.calls) == (why, calls) and why == stop
    best = best_of_buckets(got.papers, 5).collect()
    assert [r.paper for r in best] == [w[0] for w in sorted(wanted, key=lambda w: (-w[4], w[1], w[3]))[:5]]


def plain_rounds(edges, papers, authorship, seeds, rounds, per_round, calls, entering, least, mega, p):
    cites, citing = {}, {}
    for s, d, pos in edges:
        cites.setdefault(s, []).append((pos, d))
        citing.setdefault(d, set()).add(s)
    own, count = {}, {}
    for paper, author, pos, n in authorship:
        own.setdefault(paper, []).append((pos, n, author))
        count.setdefault(author, []).append(paper)
    seeds = sorted(s for s in seeds if s in papers)
    found, nodes, followed, known, synced = {s: (0, "seed", None) for s in seeds}, dict.fromkeys(seeds, 0), {}, set(), {}
    expanded, used = set(), 0
    for at in range(1, rounds + 1):
        if used >= calls:
            return found, nodes, followed, synced, "calls", used
        near = {}
        for s, d in synced:
            near.setdefault(s, set()).add(d)
            near.setdefault(d, set()).add(s)
        ranked = []
        for x in nodes:
            if x not in expanded:
                year, _, relevance, bridge, _ = papers[x]
                fresh = sum(1 for y in near.get(x, ()) if y not in expanded)
                ranked.append((-((1.0 if x in seeds else relevance) + min(fresh / 10, 0.3) + 0.2 * bridge - (0.1 if p.as_of_year - year > 10 else 0)), x))
        queue = [x for _, x in sorted(ranked)[: min(per_round, calls - used)]]
        if not queue:
            return found, nodes, followed, synced, "exhausted", used
        taken, plan = dict(followed), []
        for x in queue:
            _, cited, relevance, _, _ = papers[x]
            hub = "mega" if cited >= p.mega_citations else "suppressed" if cited >= p.hub_citations and (1.0 if x in seeds else relevance) < p.hub_relevance else "hub" if cited >= p.hub_citations else "none"
            most = (20, 10, 5) if x in seeds and hub != "none" else {"none": (50, 30, 20), "hub": (25, 15, 10)}.get(hub, (0, 0, 0))
            authors, works = [], 0
            if most[2]:
                ends = sorted((0 if pos == n else 1, a) for pos, n, a in own.get(x, []) if pos in (1, n))
                for _, a in ends:
                    if len(count[a]) >= mega or a in taken:
                        continue
                    taken[a] = x
                    if works >= most[2]:
                        continue
                    recent = sorted((-papers[w][1], w) for w in count[a] if papers[w][0] >= p.as_of_year - 5)[:10]
                    older = sorted((-papers[w][1], w) for w in count[a] if papers[w][0] < p.as_of_year - 5)[:5]
                    authors.append((a, [("author", w) for _, w in recent] + [("author_foundational", w) for _, w in older]))
                    works += len(recent) + len(older)
            plan.append((x, most, authors))
        for x, most, authors in plan:
            if used >= calls:
                break
            used += (most[0] > 0) + (most[1] > 0) + len(authors)
            expanded.add(x)
            ways = []
            for pos, d in sorted(cites.get(x, [])):
                if pos <= most[0]:
                    known.add((x, d))
                    ways.append(("reference", d))
            for s in sorted(citing.get(x, ()))[: most[1]]:
                known.add((s, x))
                ways.append(("citation", s))
            for a, works in authors:
                followed[a] = x
                ways += works
            for channel, y in ways:
                if y in papers and y not in found:
                    found[y] = (at, channel, x)
        waiting = sorted((-papers[x][4], x) for x in found if x not in nodes)[:entering]
        nodes.update({x: at for s, x in waiting if -s > least})
        for s, d in known:
            if s in nodes and d in nodes:
                synced.setdefault((s, d), at)
    return found, nodes, followed, synced, "calls" if used >= calls else "rounds", used


@pytest.mark.parametrize(("calls", "rounds", "stop"), [(2_000, 3, "rounds"), (17, 3, "calls"), (2_000, 9, "exhausted")])
def test_rounds_over_papers_and_authors_equal_the_plain_loop(spark, calls, rounds, stop):
    rng = random.Random(calls)
    p = Params(hub_citations=500, mega_citations=900)
    n = 90 if stop != "exhausted" else 25
    edges = [e[:3] for e in graph(rng, n, 5)]
    papers = {x: (rng.randrange(1985, 2003), rng.choice([rng.randrange(100), rng.randrange(1_000)]), round(rng.random(), 3), round(rng.random(), 3), round(rng.random(), 3)) for x in range(n)}
    authorship = []
    for x in range(n):
        names = rng.sample(range(100, 130), rng.randint(1, 4))
        authorship += [(x, a, k + 1, len(names)) for k, a in enumerate(names)]
    found, nodes, followed, synced, why, used = plain_rounds(edges, papers, authorship, [0, 7, 500], rounds, 4, calls, 8, 0.2, 12, p)
    got = alternating_expansion(
        spark.createDataFrame(edges, "src int, dst int, ref_pos int").repartition(3), spark.createDataFrame([(k, *v) for k, v in papers.items()], "paper int, year int, citation_count int, relevance double, bridge double, score double"),
        spark.createDataFrame(authorship, "paper int, author int, pos int, n_authors int"), spark.createDataFrame([(0,), (7,), (500,)], "paper int"), rounds, 4, calls, 8, 0.2, 12, p,
    )
    assert {r.paper: (r.round, r.channel, r.found_from) for r in got.papers.collect()} == found
    assert {r.paper: r.round for r in got.nodes.collect()} == nodes
    assert {r.author: r.found_from for r in got.authors.collect()} == followed
    assert {(r.src, r.dst): r["round"] for r in got.edges.collect()} == synced
    assert (got.stopped, got.calls) == (why, used) and why == stop


def test_running_sums_over_many_partitions(spark):
    from pyspark.sql import functions as F

    from athenor.functions.ranks import running

    rows = [(k, k % 5) for k in range(300)]
    got = running(spark.createDataFrame(rows, "k int, w int").repartition(7), [F.col("k").desc()], F.col("w"), "before")
    total, wanted = 0, {}
    for k, w in reversed(rows):
        wanted[k] = total
        total += w
    assert {r.k: r.before for r in got.collect()} == wanted
