"""What queries of this package must return, said independently in DuckDB SQL."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BITS = "[-1, -1, -1, -1, -1, -1, -1, -1]"


def _crc32(text: str) -> str:
    """Bit by bit: each byte is mixed in, then eight shifts."""
    bytes_ = f"flatten([list_prepend(ord(x), {_BITS}) for x in string_split({text}, '')])"
    step = "case when b >= 0 then xor(c, b) else xor(c >> 1, 3988292384 * (c & 1)) end"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bytes_}), lambda c, b: {step}), 4294967295)"


def _record(text: str) -> str:
    fields = ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)
    told = " || ".join(f"coalesce(strlen({f})::varchar || ':' || {f}, '-')" for f in fields)
    return f"sha256({told})"


def _step(keys: str) -> str:
    """One step of a climb: the siblings are appended, the own hash is put in its place."""
    return f"""select {keys}, c.idx // 16, c.level + 1,
        sha256(array_to_string(list_transform(k.members, lambda x, i: case when i = c.idx % 16 + 1 then c.hash else x end), '')),
        c.proof || array_to_string(list_filter(k.members, lambda x, i: i != c.idx % 16 + 1), '')"""


MERKLE = f"""with recursive
    src as (select *, translate(text, '{_UPPER}', '{_UPPER.lower()}') as low from documents),
    hashed as (select doc_id, coalesce('s' || source, '') as grp, {_record('text')} as leaf,
        case when {_crc32('doc_id::varchar')} % 5 = 0 then {_record('low')} else {_record('text')} end as found
      from src),
    ranked as (select *, count(*) over (partition by grp) as n, dense_rank() over (order by grp) - 1 as tree,
        row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as pos from hashed),
    lev(tree, level, idx, digest, n) as (
      select tree, 0, pos, leaf, n from ranked
      union all
      select tree, level + 1, idx // 16, sha256(string_agg(digest, '' order by idx)), (max(n) + 15) // 16
      from lev where n > 1 group by tree, level, idx // 16),
    subs as (select tree, level, digest as subroot from lev where n = 1),
    tops(level, idx, digest, n) as (
      select 0, tree, subroot, (select count(*) from subs) from subs
      union all
      select level + 1, idx // 16, sha256(string_agg(digest, '' order by idx)), (max(n) + 15) // 16
      from tops where n > 1 group by level, idx // 16),
    kids as (select tree, level, idx // 16 as run, list(digest order by idx) as members
      from lev where n > 1 group by all),
    top_kids as (select level, idx // 16 as run, list(digest order by idx) as members
      from tops where n > 1 group by all),
    climb(tree, pos, idx, level, hash, proof) as (
      select tree, pos, pos, 0, found, '' from ranked
      union all
      {_step('c.tree, c.pos')}
      from climb c join kids k on k.tree = c.tree and k.level = c.level and k.run = c.idx // 16),
    ascend(tree, pos, idx, level, hash, proof) as (
      select c.tree, c.pos, c.tree, 0, c.hash, c.proof from climb c join subs s on s.tree = c.tree and s.level = c.level
      union all
      {_step('c.tree, c.pos')}
      from ascend c join top_kids k on k.level = c.level and k.run = c.idx // 16),
    ended as (select *, row_number() over (partition by tree, pos order by level desc) as last from ascend)
    select r.doc_id, r.leaf, s.subroot, t.digest as root, sha256(e.proof) as proof_sha256,
      e.hash as folded_root, e.hash = t.digest as verified
    from ranked r join subs s using (tree) join ended e using (tree, pos)
      cross join (select digest from tops where n = 1) t
    where e.last = 1"""

NEGATIVES = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        [floor(256 * x::double)::hugeint for x in embedding] as q from embeddings
      where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    p as (select a.vec_id as anchor, a.label as anchor_label, b.vec_id as other, b.label,
        coalesce(list_sum([x[1] * x[2] for x in list_zip(a.q, b.q)]), 0)::bigint as score
      from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
    pos as (select * from p where label = anchor_label
      qualify row_number() over (partition by anchor order by score desc, other) <= 5),
    neg as (select pos.anchor, pos.other as positive, pos.score as ps, p.other as negative, p.score as ns,
        row_number() over (partition by pos.anchor, pos.other order by p.score desc, p.other) as rank
      from pos join p on p.anchor = pos.anchor and p.label <> p.anchor_label
        and 50 * pos.score <= 100 * p.score and 100 * p.score <= 95 * pos.score)
    select anchor as anchor_id, positive as positive_id, rank::int as rank, negative as negative_id,
      ps as positive_score, ns as negative_score from neg where rank <= 3"""

SQL = {"op12_hard_negatives": NEGATIVES, "op11_merkle_manifest": MERKLE}
