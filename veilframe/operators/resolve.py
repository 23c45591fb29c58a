"""Conflict resolution between overlapping spans, inside the row."""

from __future__ import annotations

from veilframe.functions.spans import NO_SPANS, blocks_of

# A cluster of more spans is settled by sweeps, what few spans those leave by comparing all.
FEW = 64
SWEEPS = 16


def _greedy(cluster: str) -> str:
    """Accept the spans of a cluster best first, each unless it overlaps one
    accepted before.  Best: fail action, confidence, length, entity priority,
    then discovery order."""
    rank = """'soft', if(e.span.action = 'fail', 0, 1), 'confidence', -e.span.confidence, 'length', e.start - e.end,
        'priority', -e.span.priority, 'place', e.span.place, 'found', e.found"""
    ranked = f"sort_array(transform({cluster}, e -> named_struct({rank}, 'span', e.span)))"
    few = f"""sort_array(aggregate(
        {ranked},
        {NO_SPANS},
        (kept, k) -> if(
            exists(kept, a -> a.start < k.span.end and k.span.start < a.end), kept, concat(kept, array(k.span)))))"""
    return f"""if(size({cluster}) = 1, transform({cluster}, e -> e.span),
        if(size({cluster}) <= {FEW}, {few}, {_greedy_by_sweeps(cluster, rank)}))"""


def _greedy_by_sweeps(cluster: str, rank: str) -> str:
    """The same choice for a large cluster, whose spans come in order of start.

    A sweep holds one span.  A span that overlaps the held one takes its place if
    it ranks better; one that starts behind it settles the held one as accepted,
    because all that overlap that ranked worse or overlap one settled earlier.
    What overlaps an accepted span is dropped, and the rest is swept from the
    other end, so ranks that rise along a chain cost no more than ranks that fall.
    Names under one address take one sweep.  Spans that 16 sweeps
    leave are compared with each other.

    A fold copies its state in every step: that is numbers of spans only.
    """
    entries = f"""transform({cluster},
        e -> named_struct('low', e.start, 'high', e.end, 'rank', named_struct({rank}), 'span', e.span))"""
    ints = "cast(array() as array<int>)"
    # 'before' holds, for each span, how many were settled when it was met: the next one is the first that ends behind its start.
    held = "named_struct('low', s.low, 'high', s.high, 'rank', s.rank, 'n', acc.n)"
    step = f"""if(s.low >= acc.held.high,
        named_struct('n', acc.n + 1, 'held', {held}, 'count', acc.count + 1, 'settled', concat(acc.settled, array(acc.held.n)),
            'before', concat(acc.before, array(acc.count + 1))),
        named_struct('n', acc.n + 1, 'held', if(s.rank < acc.held.rank, {held}, acc.held), 'count', acc.count,
            'settled', acc.settled, 'before', concat(acc.before, array(acc.count))))"""
    in_block = f"""aggregate(blk,
        named_struct('n', w.n, 'held', w.held, 'count', w.count, 'settled', {ints}, 'before', {ints}), (acc, s) -> {step},
        r -> named_struct('n', r.n, 'held', r.held, 'count', r.count,
            'settled', concat(w.settled, array(r.settled)), 'before', concat(w.before, array(r.before))))"""
    first = "named_struct('low', left[0].low, 'high', left[0].high, 'rank', left[0].rank, 'n', 0)"
    sweep = f"""aggregate({blocks_of('left')},
        named_struct('n', 0, 'held', {first}, 'count', 0, 'settled', array({ints}), 'before', array({ints})),
        (w, blk) -> {in_block},
        w -> named_struct('settled', concat(flatten(w.settled), array(w.held.n)), 'before', flatten(w.before)))"""
    rest = """sort_array(transform(filter(left, (s, i) -> left[r.settled[r.before[i]]].low >= s.high),
        s -> named_struct('low', -s.high, 'high', -s.low, 'rank', s.rank, 'span', s.span)))"""
    turn = f"""transform(array(z.left), left -> transform(array({sweep}), r -> named_struct(
        'left', {rest}, 'kept', concat(z.kept, transform(r.settled, i -> left[i].span))))[0])[0]"""
    compared = f"""aggregate(sort_array(transform(z.left, e -> named_struct('rank', e.rank, 'span', e.span))), {NO_SPANS},
        (kept, k) -> if(exists(kept, a -> a.start < k.span.end and k.span.start < a.end), kept, concat(kept, array(k.span))))"""
    return f"""aggregate(sequence(1, {SWEEPS}), named_struct('left', {entries}, 'kept', {NO_SPANS}),
        (z, j) -> if(size(z.left) = 0, z, {turn}),
        z -> sort_array(concat(z.kept, {compared})))"""


def _clustered(spans: str) -> str:
    """The choice among overlapping spans.  In start order, a span that starts
    where all earlier ones have ended opens a cluster, and the greedy choice
    looks at one cluster at a time.  The result equals the choice over the whole
    document, because spans of different clusters never overlap."""
    ordered = f"""sort_array(filter(
        transform({spans}, (s, i) -> named_struct('start', s.start, 'end', s.end, 'found', i, 'span', s)),
        s -> s.end > s.start))"""
    # How far the earlier spans reach: over whole blocks, then inside each block.
    reach_of_blocks = """aggregate(bs, named_struct('reach', 0, 'out', cast(array() as array<int>)),
        (acc, blk) -> named_struct('reach', greatest(acc.reach, array_max(blk.end)), 'out', concat(acc.out, array(acc.reach))),
        acc -> acc.out)"""
    reach = f"""transform(array({blocks_of('es')}), bs -> flatten(zip_with(bs, {reach_of_blocks},
        (blk, before) -> aggregate(blk, named_struct('reach', before, 'out', cast(array() as array<int>)),
            (acc, e) -> named_struct('reach', greatest(acc.reach, e.end), 'out', concat(acc.out, array(acc.reach))),
            acc -> acc.out))))[0]"""
    heads = "filter(transform(es, (e, i) -> if(e.start >= rs[i], i, null)), i -> i is not null)"
    clusters = "transform(hs, (h, j) -> slice(es, h + 1, coalesce(get(hs, j + 1), size(es)) - h))"
    return f"""transform(array({ordered}), es -> transform(array({reach}), rs -> transform(array({heads}), hs ->
        flatten(transform({clusters}, c -> {_greedy('c')})))[0])[0])[0]"""


def resolve_sql(spans: str) -> str:
    """Spans in discovery order to the accepted ones in text order.

    Most documents have no overlap, which shows between neighbours in start
    order; only the others need a choice.
    """
    apart = "not exists(transform(o, (s, i) -> coalesce(get(o, i + 1).start < s.end, false)), x -> x)"
    ordered = f"sort_array(filter({spans}, s -> s.end > s.start))"
    return f"""if(size({spans}) = 0, {NO_SPANS},
        transform(array({ordered}), o -> if({apart}, o, {_clustered(spans)}))[0])"""
