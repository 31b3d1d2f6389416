"""The queries of this package that SQL can express, for another engine."""

from .repetition import COVERAGE, LEAST_WORDS, LINES, MOST_REPEATED, WINDOW

WORD = r"[^\x20\x09-\x0D]+"

LINE_DEDUP = r"""
with line as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place
  from documents
), keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from line
), common as (
  select key from keyed where length(key) >= 1 group by key having count(distinct doc_id) >= 10
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where key in (select key from common))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (where key not in (select key from common)), '')) as kept_sha256
from keyed group by doc_id
"""


def _covered(n):
    """Characters of words in sequences of n words that occur again in the same text."""
    return f"""
  select doc_id, sum(length(word) * hit)::bigint as chars, sum(hit)::bigint as words from (
    select doc_id, word, max(often) over (partition by doc_id order by place rows between {n - 1} preceding and current row) as hit from (
      select doc_id, place, word, case when gram is not null and count(*) over (partition by doc_id, gram) > 1 then 1 else 0 end as often from (
        select doc_id, place, word, case when place + {n - 1} <= n_words then array_to_string(words[place : place + {n - 1}], ' ') end as gram
        from word))) group by doc_id"""


def quality_rules():
    lengths = (WINDOW, *COVERAGE)
    good = " and ".join(
        [f"100 * coalesce(l.chars, 0) <= {LINES} * coalesce(w.chars, 0)"]
        + [f"100 * coalesce(g{n}.chars, 0) <= {limit} * coalesce(w.chars, 0)" for n, limit in COVERAGE.items()]
    )
    failed = f"coalesce(w.n, 0) < {LEAST_WORDS} or 100 * coalesce(g{WINDOW}.words, 0) > {MOST_REPEATED} * coalesce(w.n, 0)"
    return f"""
with listed as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as words from documents),
word as (select doc_id, words, len(words) as n_words, unnest(words) as word, generate_subscripts(words, 1) as place from listed),
line as (select doc_id, line, row_number() over (partition by doc_id, line) as copy from (
  select doc_id, unnest(string_split(text, chr(10))) as line from documents) where regexp_matches(line, '{WORD}')),
w as (select doc_id, count(*) as n, sum(length(word))::bigint as chars from word group by doc_id),
l as (select doc_id, count(*) as n, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')))::bigint as chars
  from line where copy > 1 group by doc_id),
{", ".join(f"g{n} as ({_covered(n)})" for n in lengths)}
select d.doc_id, coalesce(w.n, 0)::bigint as n_words, coalesce(w.chars, 0)::bigint as word_chars,
  length(regexp_replace(coalesce(d.text, ''), '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(l.n, 0)::bigint as n_dup_lines,
  coalesce(g{WINDOW}.words, 0)::bigint as n_repeat_words, coalesce(l.chars, 0)::bigint as line_chars,
  {", ".join(f"coalesce(g{n}.chars, 0)::bigint as chars_{n}" for n in COVERAGE)},
  ({failed}) as base_failed, not ({failed}) and {good} as kept
from documents d left join w using (doc_id) left join l using (doc_id)
{" ".join(f"left join g{n} using (doc_id)" for n in lengths)}
"""


TOP_K = """
with v as (
  select vec_id, row_number() over () as row, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score, q.row as query_row
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)
), r as (
  select query_id, row_number() over (partition by query_row order by score desc, vec_id)::integer as rank, vec_id, score from s
)
select * from r where rank <= 20
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RANKED = f"""
with d as (
  select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') as terms from documents
), c as (select count(*) filter (where len(terms) > 0)::bigint as n_docs, sum(len(terms))::bigint as length from d),
t as (select row, doc_id, len(terms)::bigint as n, unnest(terms) as term from d),
tf as (select row, doc_id, n, term, count(*)::bigint as tf from t group by all),
i as (
  select row, item_id, term, count(*)::bigint as times from (
    select row_number() over () as row, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) as term from benchmark) group by all
), w as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint as w from tf, c group by term, n_docs
), s as (
  select i.row as item_row, i.item_id, tf.row, tf.doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // length))))::bigint as score
  from i join tf using (term) join w using (term), c group by all
), r as (
  select item_id, row_number() over (partition by item_row order by score desc, doc_id)::integer as rank, doc_id, score
  from s where score > 0 and doc_id is not null
)
select * from r where rank <= 20
"""


def clusters(dims=64, k=8, rounds=10, scale=1024, salt="3"):
    """Each round as a table of its own; a component's mean is floored by subtracting what remains of a division."""
    assigned = lambda centres: f"""
  select v.row, arg_min(c.cluster, (d, c.cluster)) as cluster, min(d)::bigint as distance from (
    select v.row, c.cluster, list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from v, {centres} c
  ) x join v using (row) join {centres} c using (cluster) group by v.row"""  # noqa: E731
    parts = [f"""v as materialized (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
)""", f"""c0 as materialized (
  select row_number() over (order by sha256('{salt}:' || vec_id), v) - 1 as cluster, v as c from v
  qualify cluster < {k}
)"""]
    for n in range(rounds + 1):
        parts.append(f"a{n} as materialized ({assigned(f'c{n}')})")
        if n < rounds:
            parts.append(f"""m{n} as (
  select cluster, place, sum(x)::hugeint as s, count(*) as n from (
    select cluster, unnest(v) as x, generate_subscripts(v, 1) as place from a{n} join v using (row)) group by cluster, place
), c{n + 1} as materialized (
  select c.cluster, coalesce(m.c, c.c) as c from c{n} c left join (
    select cluster, list(((s - ((s % n) + n) % n) // n)::bigint order by place) as c from m{n} group by cluster) m using (cluster)
)""")
    return f"""
with {", ".join(parts)}
select vec_id, cluster::integer as cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia,
  (sum(distance) over ())::bigint as inertia, sha256(array_to_string(c.c, ',')) as centroid_sha256
from a{rounds} join v using (row) join c{rounds} c using (cluster)
"""


SQL = {
    "op2_line_dedup": LINE_DEDUP, "op7_quality_rules": quality_rules(), "op9_topk": TOP_K, "op11_clusters": clusters(),
    "op12_ranked_search": RANKED,
}
