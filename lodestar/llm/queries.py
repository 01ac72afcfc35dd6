"""The registered queries of this subpackage and the SQL of those that have any."""

from __future__ import annotations

import importlib

#: Query name -> module; each module has a function of that name.
MODULES = {
    "op1_nnls_packing": "packing",
    "op10_imatch_fingerprints": "fingerprint",
    "op2_isolation_rules": "quality",
    "op3_layout_html": "html",
    "op4_suffix_tree_scores": "suffixtree",
    "op5_suffix_array_repeats": "repeats",
    "op6_token_counts": "tokens",
    "op7_entropy_mixing": "mixing",
    "op8_segmentation_langid": "langid",
    "op9_minhash_neardup": "minhash",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


#: Near-duplicate components by all pairs that share a shingle; for small tables.
NEAR = """with recursive w as materialized (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
 s as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from w),
 d as materialized (select distinct doc_id, g from s), n as materialized (select doc_id, count(*) as n from d group by 1),
 p as materialized (select a.doc_id as x, b.doc_id as y, count(*) as k from d a join d b on a.g = b.g and a.doc_id < b.doc_id group by all),
 e as materialized (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * k >= 85 * (nx.n + ny.n - k)),
 both_ as materialized (select x, y from e union all select y, x from e),
 r(doc_id, root) as (select doc_id, doc_id from documents union select b.y, r.root from r join both_ b on b.x = r.doc_id),
 c as (select doc_id, min(root) as root from r group by 1)
select c.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.root as component_id, c.doc_id = c.root as kept from c left join n on n.doc_id = c.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op9_minhash_neardup": NEAR}
