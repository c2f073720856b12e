"""The registered queries in DuckDB SQL, written independently of the Spark plans."""

from __future__ import annotations

# Fixed values, stated here again so that a wrong pattern in the engine shows up: blanks that are
# stripped, a token, and the ends of lines.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
TOKEN_PATTERN = rf"[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}{WHITESPACE}]"
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

WS = f"'{WHITESPACE}'"
TILE = "'[^.!?\n]*[.!?\n]+|[^.!?\n]+'"
TOKEN = f"'{TOKEN_PATTERN}'"
LINES = f"'{LINE_BREAKS}'"


def _with(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


# ---------------------------------------------------------------- common table expressions

DOCS = f"docs as (select doc_id, trim(coalesce(text, ''), {WS}) as t from documents)"
SPLIT = (
    "sides as (select doc_id, t, bucket, case when bucket < 100 then 'val' else 'train' end as split "
    "from (select *, ('0x' || substr(sha256(substr(t, 1, 200)), 1, 8))::bigint % 1000 as bucket from docs))"
)
# Tiles cover the text; blank ones are dropped, and the rest is placed by a running length.
CUT = f"""tiles as (
  select doc_id, unnest(c) as raw, unnest(range(len(c))) as i
  from (select doc_id, regexp_extract_all(t, {TILE}) as c from docs where length(t) >= 100)),
placed as (
  select *, sum(length(raw)) over (partition by doc_id order by i) - length(raw) as s0 from tiles),
solid as (
  select doc_id, i, trim(raw, {WS}) as text, s0 + length(raw) - length(ltrim(raw, {WS})) as a
  from placed where trim(raw, {WS}) <> ''),
numbered as (
  select doc_id, text, a::bigint as start_idx, (a + length(text))::bigint as end_idx,
    row_number() over (partition by doc_id order by i) - 1 as sent_idx,
    count(*) over (partition by doc_id) as n_sent
  from solid),
sents as (select * from numbered where n_sent >= 2)"""
SPANS = """spans as (
  select doc_id, sent_idx, min(start_idx) over w as c0, max(end_idx) over w as c1, start_idx as t0, end_idx as t1
  from sents window w as (partition by doc_id order by sent_idx rows between 8 preceding and 1 preceding)),
pair_spans as (select doc_id, sent_idx - 1 as pair_idx, c0, c1, t0, t1 from spans where sent_idx > 0)"""
PAIRS = """pairs as (
  select p.doc_id, pair_idx, substr(t, c0 + 1, c1 - c0) as context, substr(t, t0 + 1, t1 - t0) as target, split
  from pair_spans p join sides using (doc_id))"""
ALL_PAIRS = _with(DOCS, SPLIT, CUT, SPANS, PAIRS)


def tokens(col: str) -> str:
    return f"regexp_extract_all(lower({col}), {TOKEN})"


VOCAB = f"""counted as (select token, count(*) as n from (
  select unnest({tokens("coalesce(text, '')")}) as token from documents) group by token),
vocab as (select token, n, row_number() over (order by n desc, token) + 3 as token_id from counted)"""

# Signed token buckets, summed per text: (id columns, dim, v).
CODE = "('0x' || substr(md5(token), 1, 8))::bigint"


def sums(name: str, source: str, ids: str, col: str) -> str:
    """Sparse concept sums of ``col`` in ``source``."""
    return f"""{name} as (
  select {ids}, dim, sum(sign)::bigint as v from (
    select {ids}, h % 64 as dim, case when (h // 64) % 2 = 0 then 1 else -1 end as sign
    from (select {ids}, {CODE} as h from (select {ids}, unnest({tokens(col)}) as token from {source})))
  group by {ids}, dim having sum(sign) <> 0)"""


def dense(name: str, texts: str, source: str, id_col: str) -> str:
    """The sums as one fixed-size array per id."""
    return f"""{name} as (
  select {id_col}, list(coalesce(v, 0)::double order by dim)::double[64] as x
  from (select {id_col}, unnest(range(64)) as dim from {texts}) left join {source} using ({id_col}, dim)
  group by {id_col})"""


COS = "case when na * nb > 0 then dot / sqrt(na * nb) else 0.0 end"


def r6(e: str) -> str:
    return f"round_even(({e})::double * 1e6, 0) / 1e6 + 0.0"


NEIGHBOURS = """nb as (
  select a.vec_id, a.embedding::double[] as p, b.embedding::double[] as t
  from embeddings a join embeddings b on b.vec_id = a.vec_id + 1),
scored as (
  select *, list_dot_product(p, t) / sqrt(list_dot_product(p, p) * list_dot_product(t, t)) as cosine,
    sqrt(list_dot_product(p, p)) as pn, sqrt(list_dot_product(t, t)) as tn, vec_id // 32 as batch_id
  from nb)"""

LOG = """log as (
  select (event_id // 1000 + 1)::int as epoch, event_id as step, value as loss,
    1e-3 / (1.0 + event_id / 1000.0::double) as lr,
    1.0 - (1.0 - 0.996::double) * 0.5 * (1 + cos(pi() * least(event_id / 10000.0::double, 1.0))) as momentum,
    value * 2.0 + 0.25 as time_ms
  from events)"""

LOGITS = """logits as (
  select vec_id as step_id, unnest(range(64)) as token_id, unnest(embedding)::double * 20.0 as logit
  from embeddings)"""


def softmax(source: str, name: str) -> str:
    return f"""{name} as (
  select step_id, token_id, logit, e / sum(e) over (partition by step_id) as prob
  from (select *, exp(logit - max(logit) over (partition by step_id)) as e from {source}))"""


def nucleus(source: str, name: str, p: float) -> str:
    return f"""{name}_mass as (
  select *, coalesce(sum(prob) over (partition by step_id order by logit desc, token_id
    rows between unbounded preceding and 1 preceding), 0) as before from {source}),
{name} as (select step_id, token_id, logit from {name}_mass where before <= {p})"""


FINAL_PROBS = f"select step_id, token_id, {r6('prob')} as prob from final"

LABELLED = """words as (
  select doc_id, pair_idx, context, target,
    list_distinct(regexp_extract_all(lower(context), '[a-z0-9]+')) as a,
    list_distinct(regexp_extract_all(lower(target), '[a-z0-9]+')) as b from pairs),
labelled as (
  select doc_id, pair_idx, context, target,
    case when len(a) + len(b) > 0
      then len(list_intersect(a, b)) * 5.0::double / (len(a) + len(b) - len(list_intersect(a, b)))
      else 0.0 end as label from words)"""

PAIR_VECTORS = ",\n".join(
    [
        sums("cs", "pairs", "doc_id, pair_idx", "context"),
        sums("ts", "pairs", "doc_id, pair_idx", "target"),
        """dots as (select doc_id, pair_idx, sum(cs.v * ts.v)::double as dot
  from cs join ts using (doc_id, pair_idx, dim) group by all)""",
        "cn as (select doc_id, pair_idx, sum(v * v)::double as na from cs group by all)",
        "tn as (select doc_id, pair_idx, sum(v * v)::double as nb from ts group by all)",
        f"""sims as (
  select doc_id, pair_idx, coalesce(dot, 0) as dot, coalesce(na, 0) as na, coalesce(nb, 0) as nb,
    case when coalesce(na * nb, 0) > 0 then coalesce(dot, 0) / sqrt(na * nb) else 0.0 end as cosine
  from pairs left join dots using (doc_id, pair_idx) left join cn using (doc_id, pair_idx)
    left join tn using (doc_id, pair_idx))""",
    ]
)

# Long sentences, separator by separator; ``ord`` keeps the order of the pieces.
# Separators in the order they are tried.
SEPARATORS = ["...", "\n", "!", "?", ";", ":", ".", ",", "\t", " "]
PACK = f"""list_reduce([[w] for w in list_filter(regexp_split_to_array(seg, '[{WHITESPACE}]+'), lambda w: w <> '')],
      lambda acc, w: case when length(acc[len(acc)]) + 1 + length(w[1]) <= 256
        then acc[1:len(acc) - 1] || [acc[len(acc)] || ' ' || w[1]] else acc || w end)"""


def _pieces(source: str, name: str, parts: str) -> str:
    return f"""{name} as (
  select doc_id, ord || [k] as ord, seg from (
    select doc_id, ord, unnest(parts) as seg, unnest(range(len(parts))) as k
    from (select doc_id, ord, case when length(seg) <= 256 then [seg] else {parts} end as parts from {source})))"""


def _cut_at(level: int, separator: str) -> str:
    trimmed = f"list_filter([trim(x, {WS}) for x in string_split(seg, '{separator}')], lambda x: x <> '')"
    parts = f"case when {trimmed} = [seg] then {PACK} else {trimmed} end"
    return _pieces(f"cut{level}", f"cut{level + 1}", parts)


RESPLIT = ",\n".join(
    [
        "cut0 as (select doc_id, [i] as ord, text as seg from solid)",
        *[_cut_at(level, separator) for level, separator in enumerate(SEPARATORS)],
        _pieces(f"cut{len(SEPARATORS)}", "pieces", PACK),
        """folded as (
  select doc_id, list_reduce(
    [{'seg': '', 'cur': 0::bigint, 'spans': []::struct(a bigint, b bigint)[]}]
      || [{'seg': s, 'cur': 0::bigint, 'spans': []::struct(a bigint, b bigint)[]} for s in segs],
    lambda acc, x: case when strpos(substr(t, acc.cur + 1), x.seg) > 0 then
      {'seg': '', 'cur': acc.cur + strpos(substr(t, acc.cur + 1), x.seg) - 1 + length(x.seg),
       'spans': acc.spans || [{'a': acc.cur + strpos(substr(t, acc.cur + 1), x.seg) - 1,
         'b': acc.cur + strpos(substr(t, acc.cur + 1), x.seg) - 1 + length(x.seg)}]}
      else acc end).spans as spans
  from (select doc_id, list(seg order by ord) as segs from pieces group by doc_id) join docs using (doc_id)
  where len(segs) >= 2)""",
        """sents as (
  select doc_id, unnest(range(len(spans))) as sent_idx, unnest([s.a for s in spans]) as start_idx,
    unnest([s.b for s in spans]) as end_idx from folded)""",
    ]
)
SOLID = CUT[: CUT.index(",\nnumbered as")]

# A row of the table of common subsequence lengths per word of the original.
LCS = """list_reduce([{'w': '', 'row': [0::bigint for y in h]}] || [{'w': x, 'row': []::bigint[]} for x in r],
    lambda acc, x: {'w': '', 'row': [list_max([
      greatest(acc.row[j], case when h[j] = x.w then coalesce(acc.row[j - 1], 0) + 1 else 0 end)
      for j in range(1, k + 1)]) for k in range(1, len(h) + 1)]}).row[len(h)]"""

COPIED = """copied as (
  select a.doc_id, a.sent_idx as pair_idx, b.text as original, a.text as generated
  from sents a join sents b on a.doc_id = b.doc_id and b.sent_idx = a.sent_idx + 1)"""
ALL_COPIED = _with(DOCS, CUT, COPIED)


def overlap(word_expr: str, orders: int, tag: str = "") -> str:
    """Matches and totals per pair and order, by counting each n-gram on both sides."""
    grams = "\n union all ".join(
        f"""select doc_id, pair_idx, {n} as n, {own} as own,
    unnest([array_to_string(w[j:j + {n - 1}], ' ') for j in range(1, len(w) - {n} + 2)]) as g
    from (select doc_id, pair_idx, {word_expr.format(c=c)} as w from copied) where len(w) >= {n}"""
        for n in range(1, orders + 1)
        for c, own in (("original", 0), ("generated", 1))
    )
    return f"""grams{tag} as ({grams}),
counts{tag} as (select doc_id, pair_idx, n, g, sum(own) as h, sum(1 - own) as r from grams{tag} group by all),
overlap{tag} as (
  select doc_id, pair_idx, n, sum(least(h, r)) as m, sum(h) as h, sum(r) as r from counts{tag} group by all)"""


SPACE_WORDS = "list_filter(regexp_split_to_array({c}, '[" + WHITESPACE + "]+'), lambda x: x <> '')"
ROUGE_WORDS = "regexp_extract_all(lower({c}), '[a-z0-9]+')"

BLEU_TERMS = (
    overlap(SPACE_WORDS, 4)
    + """,
terms as (
  select doc_id, pair_idx,
    """
    + ", ".join(
        f"coalesce(sum(m) filter (n = {n}), 0) as m{n}, greatest(coalesce(sum(h) filter (n = {n}), 0), 1) as t{n}"
        for n in range(1, 5)
    )
    + """,
    coalesce(sum(h) filter (n = 1), 0) as hyp, coalesce(sum(r) filter (n = 1), 0) as ref
  from copied left join overlap using (doc_id, pair_idx) group by doc_id, pair_idx)"""
)
BLEU = (
    "case when m1 = 0 or hyp = 0 then 0.0 else "
    "(case when hyp > ref then 1.0 else exp(1.0 - ref / hyp) end) * exp(("
    + " + ".join(f"ln((case when m{n} = 0 then 0.1 else m{n} end)::double / t{n})" for n in range(1, 5))
    + ") / 4) end"
)


ROUGE = (
    "select doc_id, pair_idx, "
    + ", ".join(
        f"coalesce(max(case when m > 0 then 2 * (m / h) * (m / r) / (m / h + m / r) else 0.0 end) "
        f"filter (n = {n}), 0) as rouge{n}"
        for n in (1, 2)
    )
    + " from copied left join overlap{tag} using (doc_id, pair_idx) group by doc_id, pair_idx"
)
ROUGE_L = f"""select doc_id, pair_idx, case when len(r) > 0 and len(h) > 0 and m > 0
    then 2 * (m / len(h)) * (m / len(r)) / (m / len(h) + m / len(r)) else 0.0 end as rougeL
from (select *, case when len(r) > 0 and len(h) > 0 then {LCS} else 0 end as m from (
  select doc_id, pair_idx, {ROUGE_WORDS.format(c="original")} as r, {ROUGE_WORDS.format(c="generated")} as h from copied))"""


def _bigrams(name: str, texts: str) -> str:
    return f"""{name} as (
  select prev, next, count(*) as n from (
    select unnest(w[1:len(w) - 1]) as prev, unnest(w[2:]) as next from (
      select ['<s>'] || {tokens("text")} || ['</s>'] as w from ({texts}))) group by all)"""


CHANCES = (
    "prevs as (select prev, sum(n) as n_prev from seen group by prev)",
    "v as (select count(distinct next) + 1 as v from seen)",
)
PERPLEXITY = (
    "exp(-sum(wanted.n * ln((coalesce(seen.n, 0) + 1)::double / (coalesce(n_prev, 0) + v))) / sum(wanted.n))"
)
SCORED_BIGRAMS = "from wanted left join seen using (prev, next) left join prevs using (prev), v"


def hash_order(source: str, ids: str, seed: int) -> str:
    parts = " || '|' || ".join(["'%d'" % seed, *ids.split(", ")])
    return f"(select *, row_number() over (order by sha256({parts})) - 1 as position from {source})"


def encoded(col: str) -> str:
    """One row per token of a pair column, with its id."""
    return f"""toks as (
  select doc_id, pair_idx, unnest(w) as token, unnest(range(len(w))) as pos
  from (select doc_id, pair_idx, {tokens(col)} as w from pairs)),
coded as (
  select doc_id, pair_idx, list(coalesce(token_id, 3) order by pos) as ids
  from toks left join vocab using (token) group by all),
every as (
  select p.doc_id, p.pair_idx, coalesce(ids, []::bigint[]) as ids
  from pairs p left join coded using (doc_id, pair_idx))"""


def _funnel(source: str, max_tokens: str | None) -> str:
    over = f"len({tokens('context')}) + 2 > {max_tokens}" if max_tokens else "false"
    return f"""
, d as (select s.doc_id, length(t) as n, split = 'val' as v, coalesce(k.n_sent, 0) as k
  from {source} s left join (select distinct doc_id, n_sent from numbered) k using (doc_id)),
pp as (select split, {over} as over from pairs where doc_id in (select doc_id from {source}))
select count(*) as total_docs,
  count(*) filter (n >= 100 and k >= 2) as docs_processed,
  count(*) filter (n < 100) as docs_rejected_length,
  count(*) filter (n >= 100 and k < 2) as docs_rejected_sentences,
  (select count(*) from pp where not over) as context_target_pairs,
  (select count(*) from pp where over) as pairs_rejected_length,
  count(*) filter (n >= 100 and k >= 2 and v) as docs_val,
  (select count(*) from pp where not over and split = 'val') as pairs_val
from d"""


def _ema(key: str, momentum: str) -> str:
    return f"""with recursive s as (
  select {key} as k, event_id, value as x, {momentum} as m,
    row_number() over (partition by {key} order by event_id) as i from events),
y as (
  select k, event_id, i, x as ema from s where i = 1
  union all
  select s.k, s.event_id, s.i, s.m * y.ema + (1 - s.m) * s.x from y join s on s.k = y.k and s.i = y.i + 1)
select k as {key}, event_id, {r6('ema')} as ema from y"""


def _eigenvalues(name: str, source: str, n: int, sweeps: int = 8) -> str:
    """Eigenvalues of symmetric n x n matrices (n even), source(g, a) with the cells row by row.

    Rounds of n / 2 rotations of disjoint pairs, paired as in a round-robin; a sweep meets every pair.
    """
    m = n - 1
    other = f"(r - k + {m}) % {m}"
    paired = f"case when k = {m} then (r * {n // 2}) % {m} when {other} = k then {m} else {other} end"
    low, high = "least(k, w[k + 1])", "greatest(k, w[k + 1])"
    i, j = f"(x // {n})", f"(x % {n})"
    cell = lambda row, col: f"a[{row} * {n} + {col} + 1]"
    wi, wj = f"w[{i} + 1]", f"w[{j} + 1]"
    return f"""{name}_steps as (
  select g, 0 as r, a from {source}
  union all
  select g, r + 1, [
    c[{j} + 1] * (c[{i} + 1] * {cell(i, j)} + s[{i} + 1] * {cell(wi, j)})
      + s[{j} + 1] * (c[{i} + 1] * {cell(i, wj)} + s[{i} + 1] * {cell(wi, wj)}) for x in range({n * n})]
  from (
    select *, [1 / sqrt(1 + t * t) for t in ts] as c,
      [case when k < w[k + 1] then -ts[k + 1] else ts[k + 1] end / sqrt(1 + ts[k + 1] * ts[k + 1])
        for k in range({n})] as s
    from (
      select *, [coalesce(case when u >= 0 then 1.0 else -1.0 end / (abs(u) + sqrt(1 + u * u)), 0.0) for u in us] as ts
      from (
        select g, r, a, w,
          [({cell(high, high)} - {cell(low, low)}) / nullif(2 * {cell(low, high)}, 0) for k in range({n})] as us
        from (select g, r, a, [{paired} for k in range({n})] as w from {name}_steps where r < {sweeps * m}))))),
{name} as (select g, [a[k * {n + 1} + 1] for k in range({n})] as eig from {name}_steps where r = {sweeps * m})"""


def _solved(name: str, source: str, n: int, k: int) -> str:
    """Gauss-Jordan on source(a): n rows of a definite matrix and k right sides, row by row."""
    w = n + k
    return f"""{name}_steps as (
  select 0 as r, a from {source}
  union all
  select r + 1, [case when x // {w} = r then a[x + 1] / a[r * {w} + r + 1]
      else a[x + 1] - a[(x // {w}) * {w} + r + 1] / a[r * {w} + r + 1] * a[r * {w} + x % {w} + 1] end
    for x in range({n * w})]
  from {name}_steps where r < {n}),
{name} as (
  select x // {w} as i, x % {w} - {n} as o, v from (
    select unnest(range({n * w})) as x, unnest(a) as v from {name}_steps where r = {n}) where x % {w} >= {n})"""


def _boundaries() -> str:
    """Learned abbreviations ``abbr``, sentence starters ``starter`` and collocations ``colloc`` of all texts."""
    word = r"(?:\p{L}+\.)*\p{L}+(?:''\p{L}+)*\.?"
    clip = "least(greatest({}, 1e-12), 1 - 1e-12)"
    like = lambda k, n, p: f"({k} * ln({clip.format(p)}) + ({n} - {k}) * ln(1 - {clip.format(p)}))"

    def ratio(k1: str, n1: str, k2: str, n2: str) -> str:
        one = f"(({k1} + {k2}) / ({n1} + {n2}))"
        return (
            f"2 * ({like(k1, n1, f'{k1} / {n1}')} + {like(k2, n2, f'{k2} / {n2}')} "
            f"- {like(k1, n1, one)} - {like(k2, n2, one)})"
        )

    out = "(t.n - b.n)"
    return f"""wordlists as (select regexp_extract_all(lower(coalesce(text, '')), '{word}') as w from documents),
near as (
  select rtrim(e[1], '.') as word, e[1] like '%.' as dotted, rtrim(e[2], '.') as next, count(*)::double as n
  from (select unnest([[w[i], w[i + 1]] for i in range(1, len(w) + 1)]) as e from wordlists) group by all),
words as (select word, coalesce(sum(n) filter (dotted), 0) as dots, sum(n) as n from near group by word),
t as (select sum(n) as n, sum(dots) as dots from words),
abbr as (
  select word from (
    select word, length(replace(word, '.', '')) as size, 2 * ({like("w.dots", "w.n", "0.99")}
      - {like("w.dots", "w.n", "t.dots / t.n")}) as gain, w.n - w.dots as bare from words w, t where w.dots > 0)
  where gain * exp(-size) * (length(word) - size + 1) * pow(size::double, -bare) >= 0.3),
ends as (select next as word, sum(n) as k from near where dotted and next is not null and word not in (from abbr) group by next),
b as (select coalesce(sum(k), 0) as n from ends),
starter as (
  select word from (select word, k, w.n from ends join words w using (word)) x, t, b
  where k / b.n > (x.n - k) / {out} and {ratio("k", "b.n", "(x.n - k)", out)} >= 30),
colloc as (
  select word, next from (
    select a.word, a.next, a.n as k, w.dots as d, v.n as n
    from near a join words w on w.word = a.word join words v on v.word = a.next
    where a.dotted and a.word in (from abbr)) x, t
  where k / d > (x.n - k) / (t.n - d) and {ratio("k", "d", "(x.n - k)", "(t.n - d)")} >= 7.88)"""


def _merges(n: int) -> str:
    """Byte-pair merges one by one over counted(token, n): best0, best1, ... (l, r, c) and the words after all, ``done``."""
    parts = [
        """words0 as materialized (
  select token, n, ' ▁' || array_to_string(regexp_extract_all(token, '(?s).'), '  ') || ' ' as s from counted)"""
    ]
    for k in range(n):
        parts += [
            f"""best{k} as materialized (
  select z[1] as l, z[2] as r, sum(n)::bigint as c from (
    select n, unnest([[p[i], p[i + 1]] for i in range(1, len(p))]) as z
    from (select n, string_split(trim(s), '  ') as p from words{k})) group by all order by c desc, l, r limit 1)""",
            f"""words{k + 1} as materialized (
  select token, n, coalesce(replace(s, ' ' || l || '  ' || r || ' ', ' ' || l || r || ' '), s) as s
  from words{k} left join best{k} on true)""",
        ]
    return ",\n".join([*parts, f"done as (select token, s from words{n})"])


def _solved_groups(name: str, source: str, n: int) -> str:
    """Gauss-Jordan on source(g, a), per group n rows of a definite matrix and one right side: (g, i, v)."""
    w = n + 1
    return f"""{name}_steps as (
  select g, 0 as r, a from {source}
  union all
  select g, r + 1, [case when x // {w} = r then a[x + 1] / a[r * {w} + r + 1]
      else a[x + 1] - a[(x // {w}) * {w} + r + 1] / a[r * {w} + r + 1] * a[r * {w} + x % {w} + 1] end
    for x in range({n * w})]
  from {name}_steps where r < {n}),
{name} as (select g, unnest(range({n})) as i, unnest([a[x * {w} + {w}] for x in range({n})]) as v from {name}_steps where r = {n})"""


def _newton(n: int, rounds: int) -> str:
    """Logistic regressions by Newton's method on xs(id, tr, d, x) and ys(id, g, y): the weights ``fit``(g, i, v).

    The n-th right side of a round is the gradient; weights but that of the intercept (i = 0) are held by 1."""
    parts = [f"fit0 as materialized (select g, i, 0.0::double as v from (select distinct g from ys), (select unnest(range({n})) as i))"]
    for r in range(rounds):
        parts += [
            f"""chance{r} as materialized (
  select id, g, 1 / (1 + exp(-sum(x * v))) as p from xs join fit{r} on i = d where tr group by all)""",
            f"""sums{r} as materialized (
  select g, a.d as i, b.d as j, sum(a.x * b.x * p * (1 - p)) as v
  from chance{r} join xs a using (id) join xs b using (id) group by all
  union all select g, d, {n}, sum(x * (y - p)) from chance{r} join ys using (id, g) join xs using (id) group by all)""",
            f"""square{r} as (
  select g, list(s.v + case when i = 0 then 0 when i = j then 1 when j = {n} then -f.v else 0 end order by i, j) as a
  from sums{r} s join fit{r} f using (g, i) group by g)""",
            _solved_groups(f"step{r}", f"square{r}", n),
            f"fit{r + 1} as materialized (select g, i, f.v + s.v as v from fit{r} f join step{r} s using (g, i))",
        ]
    return ",\n".join([*parts, f"fit as (select * from fit{rounds})"])


def _probe_score() -> str:
    return f"""scores as (select id, g, sum(x * v) as s from xs join fit on i = d where not tr group by all),
best as (select id, arg_max(g, (s, -g)) as g from scores group by id)
select {r6("avg((k.label = s.label)::int)")} as probe_acc, count(*) as n_val
from best join kinds k using (g) join sided s using (id)"""


def _rank(values: str) -> str:
    """Exponential of the entropy of a list of singular values."""
    share = f"[v / list_sum({values}) for v in {values}]"
    return f"case when len({values}) = 0 then 0.0 else exp(-list_sum([p * ln(p) for p in {share}])) end"


def all_oracles() -> dict[str, str]:
    sql: dict[str, str] = {}

    # documents to pairs
    sql["documents_scan"] = _with(DOCS) + "select doc_id, length(t) as n_stripped from docs"
    sql["length_filter"] = _with(DOCS) + (
        "select doc_id, md5(t) as text_md5 from docs where length(t) >= 100"
    )
    sql["sentence_spans"] = _with(DOCS, CUT) + (
        "select doc_id, sent_idx, text, start_idx, end_idx from sents"
    )
    sql["unique_char_filter"] = _with(DOCS, CUT) + (
        "select * from (select doc_id, sent_idx, len(list_distinct(string_split(text, ''))) as n_unique "
        "from sents) where n_unique > 9"
    )
    sql["sentence_pairs"] = ALL_PAIRS + "select doc_id, split, pair_idx, context, target from pairs"
    sql["stream_pairs"] = sql["sentence_pairs"]
    sql["sentence_pairs_resplit"] = _with(DOCS, SPLIT, SOLID, RESPLIT, SPANS, PAIRS) + (
        "select doc_id, split, pair_idx, context, target from pairs"
    )
    sql["sentence_pairs_unique"] = _with(
        DOCS,
        SPLIT,
        SOLID,
        RESPLIT.replace(
            "list(seg order by ord) as segs",
            "list_filter(list(seg order by ord), lambda x: len(list_distinct(string_split(x, ''))) > 9) as segs",
        ),
        SPANS,
        PAIRS,
    ) + "select doc_id, split, pair_idx, context, target from pairs"
    sql["pair_spans"] = _with(DOCS, CUT, SPANS) + (
        "select doc_id, pair_idx, c0 as context_start, c1 as context_end, "
        "t0 as target_start, t1 as target_end from pair_spans"
    )
    sql["train_pairs"] = ALL_PAIRS + (
        "select doc_id, pair_idx, md5(context) as context_md5 from pairs where split = 'train'"
    )
    sql["pair_sink"] = ALL_PAIRS + (
        "select doc_id, pair_idx, context, target from pairs where split = 'val'"
    )
    sql["token_limit"] = ALL_PAIRS + (
        f"select * from (select doc_id, pair_idx, len({tokens('context')}) as n_tokens from pairs) "
        "where n_tokens + 2 <= 128"
    )
    sql["corpus_funnel"] = ALL_PAIRS + _funnel("sides", "128")
    sql["counted_pairs"] = f"select *, context_target_pairs as pairs_written from ({sql['corpus_funnel']})"
    sql["corpus_funnel_limit"] = (
        ALL_PAIRS
        + """, last as (
  select count(*) as n, max(doc_id) as id from (select distinct doc_id from sents order by doc_id limit 500)),
upto as (select * from sides where (select n from last) < 500 or doc_id <= (select id from last))"""
        + _funnel("upto", None)
    )
    sql["stream_funnel"] = _with(DOCS, CUT) + (
        "select reason, count(*) as n from (select case when length(t) < 100 then 'length' "
        "when coalesce(n_sent, 0) < 2 then 'sentences' else 'processed' end as reason "
        "from docs left join (select distinct doc_id, n_sent from numbered) using (doc_id)) group by reason"
    )

    # splits and shards
    sql["document_split"] = _with(DOCS, SPLIT) + "select doc_id, bucket, split from sides"
    sql["leaked_documents"] = ALL_PAIRS + (
        "select doc_id from (select doc_id, position < floor((select count(*) from pairs) * 0.9::double) as tr from "
        + hash_order("pairs", "doc_id, pair_idx", 42)
        + ") group by doc_id having count(distinct tr) > 1"
    )
    sql["corpus_funnel_failing"] = _with(DOCS, SPLIT) + f""",
k as (select doc_id, split = 'val' as v, length(t) < 100 as short, length(t) >= 100 and contains(t, '|') as failed,
    len(list_filter(string_split(t, chr(10)), lambda x: trim(x, {WS}) <> '')) as k from sides)
select count(*) as total_docs,
  count(*) filter (not short and not failed and k >= 2) as docs_processed,
  count(*) filter (short) as docs_rejected_length,
  count(*) filter (not short and not failed and k < 2) as docs_rejected_sentences,
  coalesce(sum(k - 1) filter (not short and not failed and k >= 2), 0)::bigint as context_target_pairs,
  0::bigint as pairs_rejected_length,
  count(*) filter (not short and not failed and k >= 2 and v) as docs_val,
  coalesce(sum(k - 1) filter (not short and not failed and k >= 2 and v), 0)::bigint as pairs_val,
  count(*) filter (failed) as docs_failed
from k"""
    sql["shared_prefixes"] = _with(DOCS, SPLIT) + (
        "select sha256(substr(t, 1, 200)) as prefix_hash, count(*) as n_docs, min(split) as first_side, "
        "max(split) as last_side from sides group by 1 having count(*) > 1"
    )
    sql["exact_split"] = ALL_PAIRS + (
        "select doc_id, pair_idx, case when position < floor((select count(*) from pairs) * 0.9::double) "
        "then 'train' else 'eval' end as side from " + hash_order("pairs", "doc_id, pair_idx", 42)
    )
    sql["stream_shards"] = (
        "select doc_id, g as global_idx, g % 6 as shard, (g % 6) // 2 as rank, (g % 6) % 2 as worker "
        "from (select doc_id, row_number() over (order by doc_id) - 1 as g from documents)"
    )
    sql["epoch_shards"] = (
        "with o as "
        + hash_order("documents", "doc_id", 44)
        + ", n as (select count(*) as n from documents) "
        "select doc_id, position, position % 7 as shard from o "
        "union all select doc_id, position + n, (position + n) % 7 from o, n where position < (7 - n % 7) % 7"
    )
    sql["stream_shuffle"] = "select doc_id, sha256('42|' || doc_id) as order_key from documents"
    sql["buffered_shuffle"] = (
        "select doc_id, (('0x' || substr(sha256('42|' || doc_id), 1, 8))::bigint % 4)::int as shard from documents"
    )

    # tokens and batches
    sql["vocabulary"] = _with(VOCAB) + "select token, n, token_id from vocab"
    merged = _with(VOCAB, _merges(50))
    sql["subword_vocabulary"] = merged + " union all ".join(
        f"select {k}::int as rank, l as left, r as right, c as n from best{k}" for k in range(50)
    )
    sql["subword_pieces"] = merged + "select token, array_to_string(string_split(trim(s), '  '), ' ') as pieces from done"
    pair_ctes = (DOCS, SPLIT, CUT, SPANS, PAIRS, VOCAB)
    sql["token_batches"] = (
        _with(
            *pair_ctes,
            encoded("context"),
            "framed as (select doc_id, pair_idx, [1] || ids[1:126] || [2] as ids from every)",
            "placed_rows as " + hash_order("framed", "doc_id, pair_idx", 43),
        )
        + """select doc_id, pair_idx, position, position // 32 as batch_id, seq_len, len(ids) as n_real,
  array_to_string(ids, ' ') || repeat(' 0', seq_len - len(ids)) as ids
from (select *, max(len(ids)) over (partition by position // 32) as seq_len from placed_rows)"""
    )
    sql["special_tokens"] = """with m as (
  select doc_id, case when quality = 1 then 0 end as pad_id, case when toxic = 0 then 2 end as eos_id,
    case when doc_id % 2 = 0 then 1 end as bos_id, case when doc_id % 3 = 0 then 5 end as cls_id,
    case when doc_id % 5 = 0 then 6 end as sep_id from labels)
select doc_id, coalesce(pad_id, eos_id) as pad, coalesce(bos_id, cls_id, pad_id, eos_id) as bos,
  coalesce(eos_id, sep_id, pad_id) as eos from m"""
    sql["frozen_sequences"] = (
        _with(*pair_ctes, encoded("target"))
        + """select doc_id, pair_idx, array_to_string(case when coalesce(list_position(ids, 4), 0) = 0 then ids
  else ids[1:list_position(ids, 4)] || list_transform(range(len(ids) - list_position(ids, 4)), lambda x: 0::bigint)
  end, ' ') as ids from every"""
    )
    sql["decoded_targets"] = ALL_PAIRS + (
        f"select doc_id, pair_idx, array_to_string({tokens('target')}, ' ') as text from pairs"
    )

    # vectors
    sql["document_concepts"] = (
        _with(
            sums("s", "documents", "doc_id", "text"),
            "n as (select doc_id, sqrt(sum(v * v)::double) as len from s group by doc_id)",
        )
        + f"""select doc_id, dim, {r6("coalesce(v / greatest(len, 1e-12), 0)")} as value
from (select doc_id, unnest(range(64)) as dim from documents) left join s using (doc_id, dim)
  left join n using (doc_id)"""
    )
    sql["masked_mean"] = (
        _with(
            """e as (select vec_id // 8 as seq_id, (label <> 0)::int as w, unnest(range(64)) as dim,
    unnest(embedding)::double as x from embeddings)""",
            "p as (select seq_id, dim, sum(x * w) / greatest(sum(w), 1) as mean from e group by all)",
            "l as (select seq_id, sqrt(sum(mean * mean)) as len from p group by all)",
        )
        + f"select seq_id, dim, {r6('mean')} as mean, {r6('mean / greatest(len, 1e-12)')} as unit from p join l using (seq_id)"
    )
    sql["cosine_and_norms"] = _with(NEIGHBOURS) + (
        f"select vec_id, {r6('cosine')} as cosine, {r6('pn')} as pred_norm from scored"
    )
    sql["losses"] = _with(NEIGHBOURS) + (
        "select round_even((avg(l))::double * 1e6, 0) / 1e6 + 0.0 as smooth_l1, round_even((1 - avg(cosine))::double * 1e6, 0) / 1e6 + 0.0 as cosine_loss from ("
        "select cosine, list_sum([case when abs(x) < 1 then 0.5 * x * x else abs(x) - 0.5 end "
        "for x in [a[1] - a[2] for a in list_zip(p, t)]]) / len(p) as l from scored)"
    )

    # retrieval
    query_sums = sums("qs", "benchmark", "item_id", "text")
    sql["nearest_sentences"] = (
        _with(
            DOCS,
            CUT,
            query_sums,
            sums("ss", "sents", "doc_id, sent_idx", "text"),
            "qn as (select item_id, sum(v * v)::double as na from qs group by all)",
            "sn as (select doc_id, sent_idx, sum(v * v)::double as nb from ss group by all)",
            """dots as (select item_id, doc_id, sent_idx, sum(qs.v * ss.v)::double as dot
  from qs join ss using (dim) group by all)""",
            f"""near as (select item_id, doc_id, sent_idx, {COS} as s from dots join qn using (item_id)
  join sn using (doc_id, sent_idx))""",
        )
        + f"""select item_id as query_id, doc_id, sent_idx, {r6('s')} as similarity, rank from (
  select *, row_number() over (partition by item_id order by s desc, doc_id, sent_idx) as rank from near)
where rank <= 5"""
    )
    sql["query_report"] = (
        _with(
            query_sums,
            "n as (select item_id, sqrt(sum(v * v)::double) as len from qs group by item_id)",
        )
        + "select b.item_id as query_id, "
        + ", ".join(
            f"round_even((coalesce(max(v) filter (dim = {d}) / max(len), 0))::double * 1e6, 0) / 1e6 + 0.0 as dim{d}" for d in range(8)
        )
        + ", case when max(len) > 0 then 1.0 else 0.0 end as norm from benchmark b "
        "left join qs using (item_id) left join n using (item_id) group by b.item_id"
    )
    retrieved = (
        DOCS,
        SPLIT,
        CUT,
        SPANS,
        PAIRS,
        "o as " + hash_order("pairs", "doc_id, pair_idx", 42),
        "sided as (select doc_id, pair_idx, target, position < floor((select count(*) from pairs) * 0.9::double) as tr from o)",
        "asked as (select target, min((doc_id, pair_idx)) as qid from sided where not tr group by target)",
        "given as (select target, min((doc_id, pair_idx)) as cid from sided where tr group by target)",
        sums("qs", "asked", "target", "target"),
        sums("ss", "given", "target", "target"),
        dense("qd", "asked", "qs", "target"),
        dense("sd", "given", "ss", "target"),
        "qq as (select target, x, array_inner_product(x, x) as na from qd)",
        "sq as (select cid, x, array_inner_product(x, x) as nb from sd join given using (target))",
        """best as (
  select qq.target as target, max((case when na * nb > 0 then array_inner_product(qq.x, sq.x) / sqrt(na * nb) else 0.0 end,
    -struct_extract(cid, 1), -struct_extract(cid, 2))) as top
  from qq, sq group by qq.target)""",
    )
    answers = """from sided s join best b on b.target = s.target
  join sided c on c.doc_id = -struct_extract(top, 2) and c.pair_idx = -struct_extract(top, 3)
where not s.tr"""
    sql["retrieval_decode"] = _with(*retrieved) + (
        "select s.doc_id, s.pair_idx, c.target as generated, round_even(struct_extract(top, 1) * 1e6, 0) / 1e6 + 0.0 as similarity "
        + answers
    )
    made = (
        "copied as (select s.doc_id, s.pair_idx, s.target as original, c.target as generated, "
        f"struct_extract(top, 1) as similarity {answers})"
    )
    sql["generation_samples"] = _with(*retrieved, made, BLEU_TERMS) + (
        f"select doc_id, pair_idx, original, generated, {r6(BLEU)} as bleu "
        "from terms join copied using (doc_id, pair_idx)"
    )
    totals = ", ".join(
        f"sum({c})::double as {c}" for c in [*(f"{x}{n}" for n in range(1, 5) for x in "mt"), "hyp", "ref"]
    )
    sql["generation_report"] = (
        _with(
            *retrieved,
            "copied as (select s.doc_id, s.pair_idx, s.target as original, c.target as generated, "
            f"struct_extract(top, 1) as similarity {answers})",
            BLEU_TERMS,
            overlap(ROUGE_WORDS, 2, "_rouge"),
            f"rouge as ({ROUGE.format(tag='_rouge')})",
            f"rouge_l as ({ROUGE_L})",
            _bigrams("seen", "select target as text from sided where tr"),
            _bigrams("wanted", "select original as text from copied"),
            *CHANCES,
        )
        + f"""select metric, round_even((value)::double * 1e6, 0) / 1e6 + 0.0 as value from (
  select 'bleu' as metric, {BLEU} as value from (select {totals} from terms)
  union all select 'rouge1', avg(rouge1) from rouge
  union all select 'rouge2', avg(rouge2) from rouge
  union all select 'rougeL', avg(rougeL) from rouge_l
  union all select 'perplexity', {PERPLEXITY} {SCORED_BIGRAMS}
  union all select 'concept_similarity', avg(similarity) from copied
  union all select 'diversity', count(distinct w) / count(w) from (
    select unnest({SPACE_WORDS.format(c='generated')}) as w from copied))"""
    )
    sql["line_search"] = (
        _with(
            f"""raw as (select trim(unnest(regexp_split_to_array(coalesce(text, ''), {LINES})), {WS}) as line
  from documents)""",
            "lines as (select line, row_number() over (order by line) - 1 as line_id "
            "from (select distinct line from raw where line <> ''))",
            query_sums,
            sums("ls", "lines", "line_id", "line"),
            "qn as (select item_id, sum(v * v)::double as na from qs group by all)",
            "ln as (select line_id, sum(v * v)::double as nb from ls group by all)",
            """dots as (select item_id, line_id, sum(qs.v * ls.v)::double as dot
  from qs join ls using (dim) group by all)""",
            f"near as (select item_id, line_id, {COS} as s from dots join qn using (item_id) join ln using (line_id))",
        )
        + f"""select item_id as query_id, rank, line, {r6('s')} as similarity from (
  select *, row_number() over (partition by item_id order by s desc, line_id) as rank from near)
join lines using (line_id) where rank <= 3"""
    )
    sql["sentence_lines"] = (
        "select line, count(*) as n from (select trim(unnest(regexp_split_to_array("
        f"coalesce(text, ''), {LINES})), {WS}) as line from documents) where line <> '' group by line"
    )

    # evaluation of vectors
    labelled = _with(DOCS, SPLIT, CUT, SPANS, PAIRS, LABELLED)
    sql["scored_pairs"] = labelled + (
        f"select doc_id, pair_idx, {r6('label')} as label from labelled"
    )
    sql["positive_pairs"] = labelled + (
        f"select doc_id, pair_idx, {r6('label')} as label from labelled where label > 4.0 "
        "order by doc_id, pair_idx limit 500"
    )
    sql["sts_spearman"] = (
        _with(DOCS, SPLIT, CUT, SPANS, PAIRS, LABELLED, PAIR_VECTORS)
        + """select round_even((corr(ra, rb))::double * 1e6, 0) / 1e6 + 0.0 as sts_spearman, count(*) as n_pairs from (
  select row_number() over (order by cosine, doc_id, pair_idx) as ra,
    row_number() over (order by label, doc_id, pair_idx) as rb
  from sims join labelled using (doc_id, pair_idx))"""
    )
    # For unit vectors the squared distance is 2 - 2 cos; a zero vector is at distance 1 of any unit one.
    sql["alignment"] = (
        _with(DOCS, SPLIT, CUT, SPANS, PAIRS, LABELLED, PAIR_VECTORS)
        + """select coalesce(round_even((avg(case when na > 0 and nb > 0 then 2 - 2 * cosine
    when na > 0 or nb > 0 then 1.0 else 0.0 end))::double * 1e6, 0) / 1e6 + 0.0, 'nan'::double) as alignment, count(*) as n_pos
from sims join labelled using (doc_id, pair_idx) where label > 4.0"""
    )
    sql["uniformity"] = """select round_even((ln(avg(exp(-2.0 * (2.0 - 2.0 *
    list_dot_product(a.embedding::double[], b.embedding::double[]))))))::double * 1e6, 0) / 1e6 + 0.0 as uniformity,
  count(*) as n_ordered_pairs from embeddings a join embeddings b on a.vec_id <> b.vec_id"""
    sql["text_uniformity"] = _with(
        query_sums,
        "un as (select item_id, dim, v / sqrt(sum(v * v) over (partition by item_id)) as x from qs)",
        "dots as (select a.item_id as i, b.item_id as j, sum(a.x * b.x) as dot from un a join un b using (dim) group by all)",
        """every as (select a.item_id as i, b.item_id as j from benchmark a join benchmark b on a.item_id <> b.item_id)""",
    ) + (
        f"select {r6('ln(avg(exp(-2.0 * (2.0 - 2.0 * coalesce(dot, 0)))))')} as uniformity, count(*) as n_ordered_pairs "
        "from every left join dots using (i, j)"
    )
    sql["sentence_starters"] = "with " + _boundaries() + " select word from starter"
    word = r"(?:\p{L}+\.)*\p{L}+(?:''\p{L}+)*\.?"
    sql["learned_sentences"] = _with(DOCS, CUT, _boundaries()) + rf"""select doc_id, (g - 1)::bigint as sent_idx, min(start_idx) as start_idx, max(end_idx) as end_idx
from (
  select *, sum(case when a.word is not null and (s.word is null or c.word is not null) then 0 else 1 end)
    over (partition by doc_id order by run) as g
  from (
    select *, lag(case when l like '%.' then rtrim(l, '.') end) over (partition by doc_id order by run) as prev
    from (
      select doc_id, run, min(start_idx) as start_idx, max(end_idx) as end_idx, rtrim(arg_min(head, sent_idx), '.') as first,
        coalesce(string_agg(tail, '' order by sent_idx) filter (sent_idx >= coalesce(edge, -1)), '') as l
      from (
        select *, max(sent_idx) filter (not whole) over (partition by doc_id, run) as edge
        from (
          select *, sum(case when opens and stop and gap = 0 then 0 else 1 end) over (partition by doc_id order by sent_idx) as run
          from (
            select *, lag(stops) over w as stop, start_idx - lag(end_idx) over w as gap
            from (
              select doc_id, sent_idx, start_idx, end_idx, regexp_extract(lower(text), '({word})[^\p{{L}}]*$', 1) as tail,
                regexp_extract(lower(text), '{word}') as head, regexp_matches(lower(text), '^\p{{L}}') as opens,
                regexp_matches(lower(text), '\p{{L}}\.$') as stops, regexp_matches(lower(text), '^{word}$') as whole
              from sents) window w as (partition by doc_id order by sent_idx))))
      group by doc_id, run)) x
  left join abbr a on a.word = prev left join starter s on s.word = first
  left join colloc c on c.word = prev and c.next = first)
group by doc_id, g"""
    sql["labelled_head"] = """select doc_id, quality as label, length(coalesce(text, '')) as n_chars
from (select * from labels order by doc_id limit 5000) join documents using (doc_id)"""
    sql["similarity_stats"] = _with(NEIGHBOURS) + (
        "select round_even((avg(cosine))::double * 1e6, 0) / 1e6 + 0.0 as avg_similarity, round_even((avg(pn))::double * 1e6, 0) / 1e6 + 0.0 as pred_norm, "
        "round_even((avg(tn))::double * 1e6, 0) / 1e6 + 0.0 as target_norm, count(*) as n from scored"
    )
    batch = f"""{NEIGHBOURS},
sizes as (select batch_id, count(*) as n, avg(cosine) as avg_similarity, avg(pn) as pred_norm from scored group by all),
cross_dots as (
  select a.batch_id, a.vec_id, b.vec_id as other, list_dot_product(a.p, b.t) as pt, list_dot_product(a.p, b.p) as pp
  from scored a join scored b using (batch_id)),
hits as (
  select batch_id, avg((best = vec_id)::int) as hit_rate from (
    select batch_id, vec_id, arg_max(other, (pt, -other)) as best from cross_dots group by all) group by all),
spread as (select batch_id, 1 - avg(pp) as diversity from cross_dots where vec_id <> other group by all),
flat as (select batch_id, vec_id, unnest(range(64)) as d, unnest(t) as x from scored),
stds as (select batch_id, avg(s) as target_std_mean from (
  select batch_id, d, stddev_samp(x) as s from flat group by all) group by all),
covs as (select batch_id, sum(abs(c)) as target_off_diag_cov_l1 from (
  select a.batch_id, a.d, b.d as e, covar_samp(a.x, b.x) as c from flat a
    join flat b on a.batch_id = b.batch_id and a.vec_id = b.vec_id and a.d <> b.d group by all) group by all),
centred as (select batch_id, row_number() over (partition by batch_id, d order by vec_id) - 1 as i, d,
  x - avg(x) over (partition by batch_id, d) as x from flat),
grams as (select a.batch_id, a.i * 32 + b.i as x, sum(a.x * b.x) as v
  from centred a join centred b using (batch_id, d) group by all),
squares as (select batch_id as g, list(coalesce(v, 0.0) order by x) as a
  from (select batch_id, unnest(range(1024)) as x from sizes) left join grams using (batch_id, x) group by batch_id),
{_eigenvalues("own", "squares", 32)},
ranks as (select g as batch_id, {_rank("sv")} as target_eff_rank from (
  select g, [sqrt(e) for e in eig if e > 1e-12] as sv from own)),
batches as (select * from sizes join hits using (batch_id) join spread using (batch_id)
  join stds using (batch_id) join covs using (batch_id) join ranks using (batch_id))"""
    names = [
        "avg_similarity",
        "hit_rate",
        "pred_norm",
        "diversity",
        "target_std_mean",
        "target_eff_rank",
        "target_off_diag_cov_l1",
    ]
    batch = "with recursive " + batch + "\n"
    sql["batch_metrics"] = (
        batch
        + "select batch_id, n, "
        + ", ".join(f"round_even(({c})::double * 1e6, 0) / 1e6 + 0.0 as {c}" for c in names)
        + " from batches"
    )
    sql["validation_metrics"] = (
        batch
        + "select "
        + ", ".join(f"round_even((sum({c} * n) / sum(n))::double * 1e6, 0) / 1e6 + 0.0 as {c}" for c in names)
        + ", sum(n)::bigint as total_samples from batches"
    )
    mean = lambda c: f"sum({c} * n) / sum(n)"
    sql["collapse_flags"] = batch + (
        f"select {mean('target_eff_rank')} < 10 as rank_collapsed, {mean('target_std_mean')} < 0.05 as std_collapsed, "
        f"{mean('diversity')} < 1e-3 as diversity_collapsed, {mean('avg_similarity')} > 0.999 as cosine_pinned from batches"
    )
    sql["diversity_by_label"] = """select label, any_value(n) as n, round_even((1 - avg(dot))::double * 1e6, 0) / 1e6 + 0.0 as diversity from (
  select a.label, list_dot_product(a.embedding::double[], b.embedding::double[]) as dot, n
  from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id
  join (select label, count(*) as n from embeddings group by label) c on c.label = a.label) group by label"""
    flat = "flat as (select vec_id, unnest(range(64)) as d, unnest(embedding)::double as x from embeddings)"
    sql["target_std"] = _with(flat) + (
        "select round_even((avg(s))::double * 1e6, 0) / 1e6 + 0.0 as std_mean from (select d, stddev_samp(x) as s from flat group by d)"
    )
    sql["covariance_l1"] = _with(flat) + (
        "select round_even((sum(abs(c)))::double * 1e6, 0) / 1e6 + 0.0 as off_diag_cov_l1, (select count(*) from embeddings) as n from ("
        "select a.d, b.d as e, covar_samp(a.x, b.x) as c from flat a join flat b "
        "on a.vec_id = b.vec_id and a.d <> b.d group by all)"
    )
    sql["effective_rank"] = f"""with recursive {flat},
cells as (select a.d * 64 + b.d as x, covar_samp(a.x, b.x) as c from flat a join flat b using (vec_id) group by all),
whole as (select 0 as g, list(c order by x) as a from cells),
{_eigenvalues("own", "whole", 64)},
kept as (select [sqrt(e) for e in eig if e > list_max(eig) * 64 * 2.220446049250313e-16] as sv from own)
select {r6(_rank("sv"))} as effective_rank, (select count(*) from embeddings) as n from kept"""
    sql["least_squares_probe"] = f"""with recursive sided as (
  select vec_id, label, embedding, position < floor((select count(*) from embeddings) * 0.8::double) as tr
  from {hash_order("embeddings", "vec_id", 42)}),
kinds as (select label, row_number() over (order by label) - 1 as o from (select distinct label from sided where tr)),
xs as (select vec_id, tr, unnest(range(65)) as d, unnest([1.0::double] || embedding::double[]) as x from sided),
ys as (select vec_id, o, (s.label = k.label)::int as y from sided s cross join kinds k),
n as (select count(*) as k from kinds),
normal as (select a.d as i, b.d as j, sum(a.x * b.x) as v
  from xs a join xs b using (vec_id) where a.tr group by all
  union all select x.d, 65 + y.o, sum(x.x * y.y) from xs x join ys y using (vec_id) where x.tr group by all),
square as (select list(coalesce(v, 0.0) + (i = j and i > 0)::int order by i, j) as a from (
  select unnest(range(65)) as i, j from (select unnest(range(75)) as j)) left join normal using (i, j)),
{_solved("w", "square", 65, 10)},
scores as (select vec_id, o, sum(x * v) as s from xs join w on w.i = xs.d where not tr and o < (select k from n) group by all),
best as (select vec_id, arg_max(o, (s, -o)) as o from scores group by vec_id)
select {r6("avg((k.label = s.label)::int)")} as probe_acc, count(*) as n_val
from best join kinds k using (o) join sided s using (vec_id)"""
    sql["linear_probe"] = f"""with recursive sided as (
  select vec_id as id, label, embedding::double[] as e, position < floor((select count(*) from embeddings) * 0.8::double) as tr
  from {hash_order("embeddings", "vec_id", 42)}),
kinds as (select label, row_number() over (order by label) - 1 as g from (select distinct label from sided where tr)),
xs as materialized (select id, tr, unnest(range(65)) as d, unnest([1.0::double] || e) as x from sided),
ys as materialized (select id, g, (s.label = k.label)::int as y from sided s cross join kinds k where tr),
{_newton(65, 6)},
{_probe_score()}"""
    sql["text_probe"] = f"""with recursive cut as (
  select doc_id as last from labels order by doc_id limit 1 offset greatest((select count(*) from labels) * 4 // 5 - 1, 0)),
labelled_docs as (
  select doc_id, quality as label, coalesce(text, '') as t from documents join labels using (doc_id)),
{sums("ds", "labelled_docs", "doc_id", "t")},
lengths as (select doc_id, sqrt(sum(v * v)) as l from ds group by doc_id),
sided as (select doc_id as id, label, doc_id <= (select last from cut) as tr from labelled_docs),
kinds as (select label, row_number() over (order by label) - 1 as g from (select distinct label from sided where tr)),
xs as materialized (
  select id, tr, 0 as d, 1.0::double as x from sided
  union all select id, tr, dims.dim + 1, coalesce(v / l, 0.0) from sided cross join (select unnest(range(64)) as dim) dims
    left join ds on ds.doc_id = id and ds.dim = dims.dim left join lengths on lengths.doc_id = id),
ys as materialized (select id, g, (s.label = k.label)::int as y from sided s cross join kinds k where tr),
{_newton(65, 6)},
{_probe_score()}"""
    unit = lambda name, source: f"""{name} as (select doc_id, pair_idx, dim, v / sqrt(sum(v * v) over (partition by doc_id, pair_idx)) as x
  from {source})"""  # noqa: E731
    sql["next_concept"] = "with recursive " + ",\n".join(
        [
            DOCS, SPLIT, CUT, SPANS, PAIRS,
            sums("cs", "pairs", "doc_id, pair_idx", "context"),
            sums("ts", "pairs", "doc_id, pair_idx", "target"),
            unit("cu", "cs"),
            unit("tu", "ts"),
            """normal as (
  select a.dim as i, b.dim as j, sum(a.x * b.x) as v from cu a join cu b using (doc_id, pair_idx)
    join pairs p using (doc_id, pair_idx) where split = 'train' group by all
  union all select a.dim, 64 + b.dim, sum(a.x * b.x) from cu a join tu b using (doc_id, pair_idx)
    join pairs p using (doc_id, pair_idx) where split = 'train' group by all)""",
            """square as (select list(coalesce(v, 0.0) + (i = j)::int order by i, j) as a from (
  select unnest(range(64)) as i, j from (select unnest(range(128)) as j)) left join normal using (i, j))""",
            _solved("w", "square", 64, 64),
            """made as (select doc_id, pair_idx, o as dim, sum(x * w.v) as x from cu join w on w.i = cu.dim
    join pairs using (doc_id, pair_idx) where split = 'val' group by all)""",
            "lengths as (select doc_id, pair_idx, sqrt(sum(x * x)) as l from made group by all)",
            "dots as (select doc_id, pair_idx, sum(made.x * tu.x) as dot from made join tu using (doc_id, pair_idx, dim) group by all)",
        ]
    ) + f"""
select doc_id, pair_idx, {r6("coalesce(case when l > 0 then dot / l end, 0.0)")} as similarity
from pairs left join dots using (doc_id, pair_idx) left join lengths using (doc_id, pair_idx) where split = 'val'"""
    sql["similarity_histogram"] = _with(NEIGHBOURS) + (
        "select case when cosine < -1 then 0 when cosine >= 1 then 21 "
        "else floor((cosine + 1) / 2 * 20)::bigint + 1 end as bin, count(*) as n from scored group by 1"
    )
    sql["example_sampler"] = (
        _with(
            DOCS,
            SPLIT,
            CUT,
            SPANS,
            PAIRS.replace("pairs as (", "every_pair as (", 1),
            "pairs as (select * from every_pair order by doc_id, pair_idx limit 5)",
            PAIR_VECTORS,
        )
        + f"""select doc_id, pair_idx, {r6('cosine')} as similarity, {r6('sqrt(na)')} as context_norm,
  {r6('sqrt(nb)')} as target_norm, side, unnest(range((length(x) + 99) // 100)) as line_no,
  unnest([substr(x, 100 * j + 1, 100) for j in range((length(x) + 99) // 100)]) as line
from sims join (select doc_id, pair_idx, 'context' as side, context as x from pairs
  union all select doc_id, pair_idx, 'target', target from pairs) using (doc_id, pair_idx)"""
    )

    # generated text
    bleu = ALL_COPIED.rstrip() + ",\n" + BLEU_TERMS + "\n"
    sql["corpus_bleu"] = bleu + f"select round_even(({BLEU})::double * 1e6, 0) / 1e6 + 0.0 as bleu from (select {totals} from terms)"
    sql["sentence_bleu"] = bleu + f"select doc_id, pair_idx, round_even(({BLEU})::double * 1e6, 0) / 1e6 + 0.0 as bleu from terms"
    sql["rouge"] = _with(DOCS, CUT, COPIED, overlap(ROUGE_WORDS, 2)) + (
        f"select doc_id, pair_idx, {r6('rouge1')} as rouge1, {r6('rouge2')} as rouge2 from ({ROUGE.format(tag='')})"
    )
    sql["rouge_l"] = ALL_COPIED + f"select doc_id, pair_idx, {r6('rougeL')} as rougeL from ({ROUGE_L})"
    sided_text = "select coalesce(text, '') as text from documents join sides using (doc_id) where split = '{}'"
    sql["perplexity"] = (
        _with(DOCS, SPLIT, _bigrams("seen", sided_text.format("train")), _bigrams("wanted", sided_text.format("val")), *CHANCES)
        + f"select round_even(({PERPLEXITY})::double * 1e6, 0) / 1e6 + 0.0 as perplexity, sum(wanted.n)::bigint as n_tokens " + SCORED_BIGRAMS
    )
    sql["word_diversity"] = (
        "select round_even((count(distinct w) / count(w))::double * 1e6, 0) / 1e6 + 0.0 as diversity from (select unnest("
        + SPACE_WORDS.format(c="text")
        + ") as w from documents)"
    )
    sql["concept_similarity"] = (
        _with(
            DOCS,
            CUT,
            COPIED,
            sums("a", "copied", "doc_id, pair_idx", "original"),
            sums("b", "copied", "doc_id, pair_idx", "generated"),
            """dots as (select doc_id, pair_idx, sum(a.v * b.v)::double as dot from a
  join b using (doc_id, pair_idx, dim) group by all)""",
            "an as (select doc_id, pair_idx, sum(v * v)::double as na from a group by all)",
            "bn as (select doc_id, pair_idx, sum(v * v)::double as nb from b group by all)",
        )
        + """select round_even((avg(case when coalesce(na * nb, 0) > 0 then coalesce(dot, 0) / sqrt(na * nb) else 0.0 end))::double * 1e6, 0) / 1e6 + 0.0
    as concept_similarity
from copied left join dots using (doc_id, pair_idx) left join an using (doc_id, pair_idx)
  left join bn using (doc_id, pair_idx)"""
    )

    # logits
    sql["tempered_softmax"] = (
        _with(LOGITS, "cool as (select step_id, token_id, logit / 0.7 as logit from logits)", softmax("cool", "final"))
        + FINAL_PROBS
    )
    kth = lambda k: f"""top as (
  select l.* from logits l join (
    select step_id, min(logit) as edge from (
      select *, row_number() over (partition by step_id order by logit desc) as i from logits)
    where i <= {k} group by step_id) using (step_id) where logit >= edge)"""  # noqa: E731
    sql["top_k_filter"] = _with(LOGITS, kth(10), softmax("top", "final")) + FINAL_PROBS
    sql["top_p_filter"] = (
        _with(LOGITS, kth(40), softmax("top", "massed"), nucleus("massed", "kept", 0.9), softmax("kept", "final"))
        + FINAL_PROBS
    )
    sql["greedy_tokens"] = _with(LOGITS) + (
        "select step_id, arg_max(token_id, (logit, -token_id)) as token_id from logits group by step_id"
    )
    sql["drawn_tokens"] = (
        _with(
            LOGITS,
            "warm as (select step_id, token_id, logit / 1.3 as logit from logits)",
            softmax("warm", "massed"),
            nucleus("massed", "kept", 0.9),
            """noisy as (select *, (('0x' || substr(md5('7|' || step_id || '|' || token_id), 1, 12))::bigint + 0.5)
    / 281474976710656.0::double as u from kept)""",
        )
        + "select step_id, arg_max(token_id, (logit - ln(-ln(u)), -token_id)) as token_id from noisy group by step_id"
    )

    # telemetry
    sql["csv_log"] = _with(LOG) + (
        "select epoch, step, printf('%.5f', loss)::double as loss, printf('%.6f', lr)::double as lr, "
        "printf('%.4f', momentum)::double as momentum, printf('%.2f', time_ms)::double as time_ms from log"
    )
    sql["latest_snapshot"] = _with(LOG) + (
        "select 'checkpoint-epoch' || epoch || '.pth' as name, epoch::bigint as epoch from ("
        "select max(epoch) as epoch from log where step % 3 <> 0)"
    )
    sql["logged_steps"] = _with(LOG) + "select epoch, step, loss from log where step % 50 = 0"
    sql["loss_meter"] = _with(LOG) + (
        "select epoch, arg_max(loss, step) as last, round_even((sum(loss) / count(*))::double * 1e6, 0) / 1e6 + 0.0 as avg, "
        "round(sum(loss), 4) as sum, count(*) as count, min(loss) as min, max(loss) as max from log group by epoch"
    )
    sql["best_steps"] = _with(LOG) + (
        "select step, loss from (select step, loss, min(loss) over (order by step rows between unbounded "
        "preceding and 1 preceding) as low from log) where low is null or loss < low"
    )
    sql["accumulated_steps"] = _with(LOG) + (
        "select step // 8 as step, round_even((avg(loss))::double * 1e6, 0) / 1e6 + 0.0 as loss, 1024 as effective_batch from log "
        "group by step // 8 having count(*) = 8"
    )
    sql["momentum_schedule"] = _with(LOG) + "select step, round_even((momentum)::double * 1e6, 0) / 1e6 + 0.0 as momentum from log"
    sql["ema_by_user"] = _ema("user_id", "0.9::double")
    sql["ema_scheduled"] = _ema(
        "event_type",
        "1.0 - 0.5 * 0.5 * (1 + cos(pi() * least(event_id / 10000.0::double, 1.0)))",
    )
    sql["step_budget"] = ALL_PAIRS + (
        """select n as rows, 5 * k as total_steps, k as steps_per_epoch from (
  select n, greatest((((n + 3) // 4 + 31) // 32) // 8, 1) as k
  from (select count(*) as n from pairs where split = 'train'))"""
    )
    return sql
