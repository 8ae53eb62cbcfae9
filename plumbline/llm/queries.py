"""Queries of the package for the driver's entry, and their SQL where SQL can express them."""
from __future__ import annotations

from plumbline.llm import p1, p3, p4, p5, p7, p8, p9

QUERIES = {
    "p1_found": p1.found, "p1_report": p1.report, "p1_members": p1.members,
    "p3_found": p3.every, "p3_groups": p3.groups,
    "p4_found": p4.found, "p4_split": p4.split, "p4_generator_split": p4.generator_split,
    "p5_found": p5.found, "p5_ranking": p5.ranking,
    "p7_ids": p7.ids,
    "p8_found": p8.found, "p8_containers": p8.containers,
    "p9_found": p9.found, "p9_redacted": p9.redacted,
}

_P5 = """
with g as (select review_id, """ + ", ".join(f"max(case when isnan({c}) then null else {c} end) s{i}" for i, c in enumerate(p5.SCORES)) + """ from graph_speagle where review_id is not null group by 1),
 l as (unpivot g on s0, s1, s2, s3 into name s value v),
 n as (select *, count(*) over (partition by s) known, rank() over (partition by s order by v desc) - 1 larger from l)"""
#: Words of texts and their counts; two texts meet on their words.
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_P1 = f"""
with f as (select distinct lower(trim(fold)) f, lower(trim(split_role)) as role from fold_roles),
 r as (select distinct id, source_dataset, text, f.role, f.role = 'train' tr from reviews join f on lower(trim(fold)) = f.f where f.role in ('train', 'validation', 'test')),
 b as (select id, tr, array_to_string({_WORDS}, ' ') class, {_WORDS} w from r where len({_WORDS}) >= 8),
 c as (select id, tr, w, count(*) n from (select id, tr, unnest(w) w from b) group by 1, 2, 3),
 t as (select id, sum(n) t from c group by 1),
 m as (select x.id x, y.id y, sum(least(x.n, y.n)) m from c x join c y on x.w = y.w and x.tr and not y.tr group by 1, 2),
 p as (select m.x, m.y from m join t tx on tx.id = m.x join t ty on ty.id = m.y where m * 10 >= 7 * (tx.t + ty.t - m))"""


def _p3(tab: str, key: str) -> str:
    return f"""(with r as (select distinct {key} id, text from {tab} where {key} is not null),
 b as (select id, {_WORDS} w from r where len({_WORDS}) >= 8),
 c as (select id, len(w) t, u, count(*) n from (select id, w, unnest(w) u from b) group by 1, 2, 3),
 m as (select x.id a, y.id b, any_value(x.t + y.t) t, sum(least(x.n, y.n)) m from c x join c y on x.u = y.u and x.id < y.id and 10 * x.t >= 7 * y.t and 10 * y.t >= 7 * x.t group by 1, 2)
 select '{tab}' tab, a id_a, b id_b from m where m * 10 >= 7 * (t - m))"""


SQL = {
    "p1_found": _P1 + " select distinct least(x, y) id_a, greatest(x, y) id_b from p",
    "p1_report": _P1 + """, e as (select id, min(role) split_role, min(source_dataset) source_dataset from r where not tr group by 1),
 k as (select b.id, count(distinct o.class) links, max((o.class = b.class)::int) same from b join p on p.y = b.id join b o on o.id = p.x where not b.tr and o.tr group by 1)
 select split_role, source_dataset, count(*) n_records, count(case when same = 1 then 1 end) n_same, count(links) n_near, coalesce(sum(links), 0)::bigint n_links from e left join k using (id) group by 1, 2""",
    "p3_found": _p3("reviews", "id") + " union all " + _p3("yelp", "review_id"),
    "p4_found": """
with recursive y as (select distinct business_id b, nullif(reviewer_id, 0) r from yelp where business_id is not null),
 e as (select distinct a.b x, c.b y from y a join (select r, min(b) b from y group by 1) c on c.r = a.r),
 g as (select x, y from e union select y, x from e),
 q as (select distinct b, b o from y union select q.b, g.y from q join g on g.x = q.o)
select min(o) business_a, b business_b from q group by b having min(o) < b""",
    "p5_found": _P5 + " select review_id from n group by 1 having count(*) = 4 and max(larger - 0.05 * known) < 0",
    "p5_ranking": _P5 + """, a as (select g.review_id, list_sort(list(coalesce(1 - larger::double / known, 0.5))) v
  from (select review_id, unnest(['s0', 's1', 's2', 's3']) s from g) g left join n on n.review_id = g.review_id and n.s = g.s group by 1)
 select review_id, row_number() over (order by v[1] desc, v[2] desc, v[3] desc, v[4] desc, review_id) place, round(v[1], 6) weakest from a""",
}
