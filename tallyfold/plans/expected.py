"""What the queries must return, said independently in DuckDB SQL."""

from __future__ import annotations

from tallyfold.operators.resampling import EDGES
from tallyfold.plans import expected_models as models
from tallyfold.plans.catalog import BANDS, GRID
from tallyfold.plans.tables import BLOCKS, MANY, WHOLE, block_candidates, seeded_candidates


def _fold(expr: str, k: int = 5, seed: str = "") -> str:
    text = f"'{seed}' || cast({expr} as varchar)"
    return f"(('0x' || substr(md5({text}), 1, 8))::bigint % {k})::int"


def _orders(key: str = "key", seed: str = "") -> str:
    keys = {
        "key": "o_orderpriority || '|' || strftime(o_orderdate, '%Y%m')",
        "coarse": "o_orderpriority",
    }
    return f"""select o_orderkey as id, o_orderstatus as y, {keys[key]} as key,
        {_fold('o_custkey', seed=seed)} as fold from orders"""


LINES = f"""select l_orderkey as id, l_returnflag as y,
    cast(cast(l_quantity as int) as varchar) || '|'
      || cast(cast(round(l_discount * 100) as int) as varchar) as key,
    {_fold('l_orderkey')} as fold from lineitem"""


def _lookup(source: str, classes: list[str], name: str = "") -> str:
    """CTEs ending in pred{name}: every row with the counts it may use (u0..) and the
    counts of its key in other folds (l0..)."""
    k = range(len(classes))
    n = ", ".join(f"count(*) filter (y = {c}) as n{i}" for i, c in enumerate(classes))
    key_sums = ", ".join(f"sum(n{i}) as n{i}" for i in k)
    left = ", ".join(f"(coalesce(t.n{i}, 0) - coalesce(o.n{i}, 0))::bigint as l{i}" for i in k)
    prior = ", ".join(f"(a.n{i} - coalesce(b.n{i}, 0))::bigint as p{i}" for i in k)
    total = " + ".join(f"l{i}" for i in k)
    use = ", ".join(f"case when {total} > 0 then l{i} else p{i} end as u{i}" for i in k)
    best = " ".join(
        f"when {' and '.join(f'u{i} >= u{j}' for j in k if j != i) or 'true'} then {c}"
        for i, c in enumerate(classes)
    )
    return f"""src{name} as ({source}),
    kf{name} as (select key, fold, {n} from src{name} where y is not null group by key, fold),
    kt{name} as (select key, {key_sums} from kf{name} group by key),
    pf{name} as (select fold, {key_sums} from kf{name} group by fold),
    pa{name} as (select {key_sums} from kf{name}),
    used{name} as (
      select s.*, {left}, {prior}
      from src{name} s cross join pa{name} a
      left join kt{name} t on s.key = t.key
      left join kf{name} o on s.key = o.key and s.fold = o.fold and s.y is not null
      left join pf{name} b on s.fold = b.fold and s.y is not null),
    decided{name} as (select *, {total} as n, {use} from used{name}),
    pred{name} as (select *, case {best} end as y_hat from decided{name})"""


STATUSES = ["'F'", "'O'", "'P'"]
FLAGS = ["'A'", "'N'", "'R'"]
ORDER_PRED = _lookup(_orders(), STATUSES)
LINE_PRED = _lookup(LINES, FLAGS)
TWO_PREDICTIONS = (_lookup(_orders("coarse"), STATUSES, "a"), _lookup(_orders(), STATUSES, "b"))
FIRST_CLASS = _lookup(_orders().replace("o_orderstatus as y", "(o_orderstatus = 'F')::int as y"), ["0", "1"])


def _per_class(pred: str, where: str = "true", extra: str = "") -> str:
    """CTE cls: class, tp, n_true, n_pred, f1 from a prediction table."""
    return f"""rows_ as (select y, y_hat from {pred} where y is not null and {where}),
    tr as (select y as class, count(*) as n_true,
                  count(*) filter (y = y_hat) as tp from rows_ group by y),
    pr as (select y_hat as class, count(*) as n_pred from rows_
           where y_hat is not null group by y_hat),
    names as (select class from tr union select class from pr {extra}),
    cls as (select class, coalesce(tp, 0)::bigint as tp, coalesce(n_true, 0)::bigint as n_true,
                   coalesce(n_pred, 0)::bigint as n_pred,
                   case when coalesce(n_true, 0) + coalesce(n_pred, 0) > 0
                     then 2e0 * coalesce(tp, 0) / (coalesce(n_true, 0) + coalesce(n_pred, 0))
                     else 0e0 end as f1
            from names left join tr using (class) left join pr using (class))"""


MACRO = "sum(n_true)::bigint as n_rows, count(*) as n_classes, round(avg(f1), 6)"

KEY_FEATURES = """id, round(ln(1e0 + n), 6) as key_log_n,
    round(greatest(u0, u1, u2)::double / (u0 + u1 + u2), 6) as key_share,
    ((l0 > 0)::int + (l1 > 0)::int + (l2 > 0)::int) as key_n_classes,
    y_hat as key_majority, (n = 0)::int as key_unseen"""


def _mismatch() -> str:
    pairs = {
        "key_log_n": ("ln(1e0 + a.n)", "ln(1e0 + b.n)", "same"),
        "key_share": (
            "greatest(a.u0, a.u1, a.u2)::double / (a.u0 + a.u1 + a.u2)",
            "greatest(b.u0, b.u1, b.u2)::double / (b.u0 + b.u1 + b.u2)",
            "same",
        ),
        "key_n_classes": (
            "((a.l0 > 0)::int + (a.l1 > 0)::int + (a.l2 > 0)::int)::double",
            "((b.l0 > 0)::int + (b.l1 > 0)::int + (b.l2 > 0)::int)::double",
            "type",
        ),
    }
    parts = [
        f"""select '{c}' as "column", '{s}' as status, count(*) as n_rows,
          count(*) filter (abs({x} - {y}) > 1e-9) as n_mismatch,
          round(count(*) filter (abs({x} - {y}) > 1e-9) / count(*)::double, 6) as mismatch_rate,
          round(max(abs({x} - {y}))::double, 6) as max_abs_diff
          from preda a join predb b using (id)"""
        for c, (x, y, s) in pairs.items()
    ]
    parts += [
        f"""select '{c}', '{s}', (select count(*) from preda join predb using (id)),
          null::bigint, null::double, null::double"""
        for c, s in (("key_unseen", "only_a"), ("key_new", "only_b"))
    ]
    a = _lookup(_orders(), STATUSES, "a")
    b = _lookup(_orders(seed="s"), STATUSES, "b")
    return f"with {a}, {b} " + " union all ".join(parts)


TEXT_SAMPLES = f"""select d.doc_id as id, d.text, l.quality as y, {_fold('d.text')} as fold
    from documents d left join labels l on d.doc_id = l.doc_id"""

# --- centroids ---------------------------------------------------------------------

CENTROIDS = f"""v as (select vec_id as id, label as y, embedding, {_fold('vec_id')} as fold
         from embeddings),
    x as (select id, y, fold, generate_subscripts(embedding, 1) - 1 as d,
                 unnest(embedding)::double as x from v),
    own as (select fold, y, d, sum(x) as s, count(*) as n from x group by all),
    tot as (select y, d, sum(s) as s, sum(n) as n from own group by all),
    fs as (select distinct fold from v),
    cen as (select fs.fold, tot.y as c, tot.d,
                   (tot.s - coalesce(own.s, 0)) / (tot.n - coalesce(own.n, 0)) as m
            from fs cross join tot
            left join own on own.fold = fs.fold and own.y = tot.y and own.d = tot.d
            where tot.n > coalesce(own.n, 0))"""


def _centroid_probs(variants: list[tuple[str, int, list[int]]]) -> str:
    """CTE p: id, y, fold, candidate, seed, c, p."""
    values = ", ".join(
        f"('{name}', {seed}, {d})" for name, seed, dims in variants for d in dims
    )
    return f"""{CENTROIDS},
    var(candidate, seed, d) as (values {values}),
    dist as (select x.id, x.y, x.fold, candidate, seed, c, sum((x.x - m) * (x.x - m)) as g
             from x join var on var.d = x.d join cen on cen.fold = x.fold and cen.d = x.d
             group by all),
    ex as (select *, exp(min(g) over w - g) as e from dist window w as
             (partition by id, candidate, seed)),
    p as (select id, y, fold, candidate, seed, c, e / sum(e) over
             (partition by id, candidate, seed) as p from ex)"""


WHOLE_BLOCKS = _centroid_probs(block_candidates((WHOLE,)))
ALL_BLOCKS = _centroid_probs(block_candidates())


def _decide(source: str, by: str, keep: str = "") -> str:
    """Highest p per group, lowest class on ties in steps of 1e-9."""
    kept = "".join(f", any_value({c}) as {c}" for c in keep.split(",") if c)
    return f"""select {by}{kept},
      arg_max(c, floor(p * 1e9 + 0.5e0)::bigint * 1000 - c) as y_hat, max(p) as top
      from {source} group by {by}"""


def _by_model_f1(pred: str, by: str) -> str:
    """CTE f1s: macro-F1 over the ten classes for each ``by``."""
    return f"""conf as (select {by}, y, y_hat, count(*) as n from {pred} group by all),
    sides as (select {by}, y as class, case when y = y_hat then n else 0 end as tp,
                     n as n_true, 0 as n_pred from conf
              union all select {by}, y_hat, 0, 0, n from conf),
    per as (select {by}, class, 2e0 * sum(tp) / (sum(n_true) + sum(n_pred)) as f1
            from sides where class between 0 and 9 group by all),
    f1s as (select {by}, sum(f1) / 10 as macro_f1 from per group by all)"""


CANDIDATES = f"""{WHOLE_BLOCKS},
    mixed as (select id, y, 'fusion' as candidate, c, sum(0.25e0 * p) as p from p
              group by id, y, c),
    longp as (select id, y, candidate, c, p from p union all select * from mixed),
    pred as ({_decide('longp', 'id, candidate', 'y')}),
    counts as (select candidate, count(*) filter (y_hat = 1) as n_candidate from pred
               group by candidate),
    guard as (select candidate, b.n_base, n_candidate,
                n_candidate::double / b.n_base as ratio,
                case when b.n_base > 0
                  then n_candidate::double / b.n_base between 0.8e0 and 1.25e0
                  else n_candidate = 0 end as passes
              from counts cross join
                (select n_candidate as n_base from counts where candidate = 'block0') b)"""

SEARCH = f"""{WHOLE_BLOCKS},
    wide as (select id, y, c, {', '.join(f"max(p) filter (candidate = '{b}') as {b}" for b in BLOCKS)}
             from p group by id, y, c),
    g as (select i, j, k, 10 - i - j - k as l from range(11) a(i), range(11) b(j), range(11) c(k)
          where i + j + k <= 10),
    w as (select i / 10e0 as w_block0, j / 10e0 as w_block1, k / 10e0 as w_block2,
                 l / 10e0 as w_block3,
                 row_number() over (order by i, j, k, l) - 1 as w from g),
    mix as (select w, id, y, c, floor((w_block0 * block0 + w_block1 * block1 + w_block2 * block2
                   + w_block3 * block3) * 1e9 + 0.5e0)::bigint as q from wide cross join w),
    pred as (select w, id, any_value(y) as y, arg_max(c, q * 1000 - c) as y_hat
             from mix group by w, id),
    {_by_model_f1('pred', 'w')},
    ranked as (select *, row_number() over (order by floor(macro_f1 * 1e9 + 0.5e0) desc, w) as rank
               from f1s)"""

SIMPLEX = f"""with {SEARCH}
    select rank::int as rank, {', '.join(f'w_{b}' for b in BLOCKS)}, round(macro_f1, 6) as macro_f1
    from ranked join w using (w) where rank <= 5"""

BEST = f"""with {SEARCH},
    longp as (select id, y, candidate, c, p from p union all
      select id, y, 'fusion', c, w_block0 * block0 + w_block1 * block1 + w_block2 * block2
        + w_block3 * block3
      from wide cross join (select w.* from w join ranked using (w) where rank = 1)),
    said as ({_decide('longp', 'id, candidate', 'y')}),
    counts as (select candidate, count(*) filter (y_hat = 1) as n from said group by candidate),
    guard as (select candidate, n::double / (select n from counts where candidate = 'block0')
                between 0.8e0 and 1.25e0 as passes from counts),
    conf2 as (select candidate, y, y_hat, count(*) as n from said group by all),
    sides2 as (select candidate, y as class, case when y = y_hat then n else 0 end as tp,
                 n as n_true, 0 as n_pred from conf2
               union all select candidate, y_hat, 0, 0, n from conf2),
    per2 as (select candidate, class, 2e0 * sum(tp) / (sum(n_true) + sum(n_pred)) as f1
             from sides2 group by all),
    pick as (select candidate from per2 join guard using (candidate) where passes
             group by candidate
             order by floor(sum(f1) / 10 * 1e9 + 0.5e0) desc, candidate limit 1)
    select id, candidate, y_hat from said join pick using (candidate)"""

# --- naive Bayes --------------------------------------------------------------------

TOKEN = r"[\p{L}\p{N}]+"
BAYES = f"""src as ({TEXT_SAMPLES}),
    s as (select id, y, case when y is null then -1 else fold end as fold, text from src),
    tk as (select id, y, fold, unnest(regexp_extract_all(lower(text), '{TOKEN}')) as token from s),
    pairs as (select id, y, fold, token, count(*) as n from tk group by all),
    own as (select token, fold, sum(n) filter (y = 0) as a, sum(n) filter (y = 1) as b
            from pairs where y is not null group by all),
    tot as (select token, sum(a) as a, sum(b) as b from own group by token),
    voc as (select count(distinct token) as v from pairs where y is not null),
    fs as (select distinct fold from s),
    size as (select fs.fold,
               (select sum(a) from tot) - coalesce((select sum(a) from own where own.fold = fs.fold), 0) as a,
               (select sum(b) from tot) - coalesce((select sum(b) from own where own.fold = fs.fold), 0) as b,
               (select count(*) from s where y = 0)
                 - (select count(*) from s where y = 0 and s.fold = fs.fold) as da,
               (select count(*) from s where y = 1)
                 - (select count(*) from s where y = 1 and s.fold = fs.fold) as db
             from fs),
    sums as (select p.id, sum(n) as n,
               sum(n * ln(1e0 + coalesce(t.a, 0) - coalesce(o.a, 0))) as a,
               sum(n * ln(1e0 + coalesce(t.b, 0) - coalesce(o.b, 0))) as b
             from pairs p left join tot t using (token)
             left join own o on o.token = p.token and o.fold = p.fold
             group by p.id),
    logits as (select s.id, s.fold, s.y,
               coalesce(u.a, 0) - coalesce(u.n, 0) * ln(z.a + 1e0 * v)
                 + ln((da + 1e0) / (da + db + 2e0)) as a,
               coalesce(u.b, 0) - coalesce(u.n, 0) * ln(z.b + 1e0 * v)
                 + ln((db + 1e0) / (da + db + 2e0)) as b
             from s join size z using (fold) cross join voc left join sums u on u.id = s.id),
    nb as (select id, fold, y, exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) as p0,
               exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) as p1
           from logits),
    sure as (select *, greatest(p0, p1) as top, floor(greatest(p0, p1) * 1e9 + 0.5e0) as q,
               case when floor(p1 * 1e9 + 0.5e0) > floor(p0 * 1e9 + 0.5e0) then 1 else 0 end as y_hat
             from nb)"""

# --- registry and files -------------------------------------------------------------

VERSION = "'v' || (year(o_orderdate) - 1990) || '.' || month(o_orderdate)"
REGISTRY = f"""reg as (select 'p' || o_custkey as project,
      case o_orderstatus when 'F' then 'local' when 'O' then 'platform' else 'smoke' end as metric,
      case o_orderpriority when '4-NOT SPECIFIED' then -1 else year(o_orderdate) - 1990 end as major,
      case o_orderpriority when '4-NOT SPECIFIED' then 0 else month(o_orderdate) end as minor,
      case o_orderpriority when '1-URGENT' then 'fix' else '' end as suffix,
      case o_orderpriority when '4-NOT SPECIFIED' then 'original'
        when '1-URGENT' then {VERSION} || '_fix' else {VERSION} end as version,
      o_orderdate as logged_at, o_totalprice / 1e6 as score from orders)"""

LOG = f"""log as (select o_orderkey as id, o_orderstatus as status,
      case when o_orderpriority = '5-LOW' then null::timestamp
        when o_orderpriority = '2-HIGH' then date_trunc('day', o_orderdate) + interval '6 hours 5 minutes 4 seconds'
        when o_orderpriority = '3-MEDIUM' then date_trunc('day', o_orderdate) + interval '21 hours 22 minutes 23 seconds'
        else date_trunc('day', o_orderdate) end as ts,
      case when o_orderpriority = '4-NOT SPECIFIED' then null else 'p' || o_custkey end as project,
      case when o_orderpriority = '4-NOT SPECIFIED' then null else {VERSION} end as version,
      case when o_orderpriority in ('2-HIGH', '3-MEDIUM') then lower(o_orderstatus) end as selected,
      case when o_orderpriority = '4-NOT SPECIFIED' then null else floor(o_totalprice) / 1e6 end as macro_f1,
      (case o_orderpriority when '4-NOT SPECIFIED' then 0 when '2-HIGH' then 2 else 1 end)::int as n_metrics,
      year(o_orderdate) - 1990 as major, month(o_orderdate) as minor
      from orders)"""

CHECK = """sub as (select l_orderkey as id, l_returnflag as y_hat from lineitem),
    ids as (select id, count(*) as n, max((y_hat not in ('A', 'N'))::int) as bad
            from sub group by id),
    chk as (select (select count(*) from orders) as n_expected,
      (select count(*) from sub) as n_submitted,
      (select count(*) from orders where o_orderkey not in (select id from ids)) as missing,
      (select count(*) from ids where id not in (select o_orderkey from orders)) as extra,
      (select count(*) from ids where n > 1) as duplicated,
      (select count(*) from ids where bad = 1) as bad_class)"""

DIFF_COLUMNS = (
    ("doc_id", "bigint", "bigint", "same", "count(doc_id)", "count(doc_id)"),
    ("text", "string", None, "only_a", "count(text)", None),
    ("lang", "string", "string", "same", "count(lang)", "count(nullif(lang, 'en'))"),
    ("source", "string", None, "only_a", "count(source)", None),
    ("n_chars", "bigint", "double", "type", "count(n_chars)", "count(n_chars)"),
    ("quality", "int", None, "only_a", "count(quality)", None),
    ("toxic", "int", "int", "same", "count(toxic)", "count(toxic)"),
    ("n_points", None, "int", "only_b", None, "count(text)"),
)


def _text(value: str | None) -> str:
    return "null::varchar" if value is None else f"'{value}'"


WINDOWED = """w as (select doc_id, text, length(text) as n, unnest([0, 1, 2]) as v from documents),
    views as (select doc_id, v, substring(text, (floor(floor(n / 2e0) * v / 2e0))::bigint + 1,
              ceil(n / 2e0)::bigint) as t from w)"""

LETTERS = "length(regexp_replace({}, '[^aeiou]', '', 'g'))"

SOUND = "0::bigint as n_null, 0::bigint as n_bad_sum, true as learns"

# many classes: the best class of a (key, fold) by its rank, not by a column for each
MANY_PRED = f"""src as (select l_orderkey as id, (l_suppkey % {MANY})::int as y,
      cast(cast(l_quantity as int) as varchar) || '|'
        || cast(cast(round(l_discount * 100) as int) as varchar) as key,
      {_fold('l_orderkey')} as fold from lineitem),
    own as (select key, fold, y, count(*) as n from src group by all),
    groups_ as (select distinct key, fold from src),
    kt as (select key, y, sum(n) as n from own group by all),
    ft as (select fold, y, sum(n) as n from own group by all),
    t as (select y, sum(n) as n from own group by all),
    here as (select g.key, g.fold, kt.y, kt.n - coalesce(own.n, 0) as n
             from groups_ g join kt using (key)
             left join own on own.key = g.key and own.fold = g.fold and own.y = kt.y),
    there as (select f.fold, t.y, t.n - coalesce(ft.n, 0) as n
              from (select distinct fold from src) f cross join t
              left join ft on ft.fold = f.fold and ft.y = t.y),
    best_here as (select key, fold, arg_max(y, n * 1000 - y) as y, sum(n) as n from here group by all),
    best_there as (select fold, arg_max(y, n * 1000 - y) as y from there group by fold),
    pred as (select s.y, case when h.n > 0 then h.y else p.y end as y_hat
             from src s join best_here h on h.key = s.key and h.fold = s.fold
             join best_there p on p.fold = s.fold)"""

SQL = {
    "oof_macro_f1": f"with {ORDER_PRED}, {_per_class('pred')} select {MACRO} as macro_f1 from cls",
    "confusion": f"with {LINE_PRED} select y, y_hat, count(*) as n from pred group by y, y_hat",
    "macro_f1_closed": f"""with {LINE_PRED}, {_per_class('pred', extra="union select 'X'")}
        select {MACRO} as macro_f1 from cls""",
    "class_f1": f"""with {LINE_PRED}, {_per_class('pred', extra="union select 'X'")}
        select class, tp, n_true, n_pred, round(f1, 6) as f1 from cls""",
    "macro_f1_positive": f"""with {LINE_PRED}, {_per_class('pred', where="y <> 'N'")}
        select {MACRO} as macro_f1_positive_rows from cls""",
    "accuracy": f"""with {LINE_PRED} select count(*) as n_rows,
        round(count(*) filter (y = y_hat) / count(*)::double, 6) as accuracy from pred""",
    "weighted_f1": f"""with {LINE_PRED}, {_per_class('pred')}
        select sum(n_true)::bigint as n_rows,
          round(sum(f1 * n_true) / sum(n_true), 6) as weighted_f1 from cls""",
    "class_delta": f"""with {_lookup(_orders('coarse'), STATUSES, 'a')},
        {_lookup(_orders('key'), STATUSES, 'b')},
        ca as (select y_hat as class, count(*) as n from preda group by 1),
        cb as (select y_hat as class, count(*) as n from predb group by 1)
        select class, coalesce(ca.n, 0) as n_a, coalesce(cb.n, 0) as n_b,
          coalesce(cb.n, 0) - coalesce(ca.n, 0) as delta
        from ca full join cb using (class)""",
    "flip_matrix": f"""with {_lookup(_orders('coarse'), STATUSES, 'a')},
        {_lookup(_orders('key'), STATUSES, 'b')}
        select a.y_hat as old, b.y_hat as new, count(*) as n
        from preda a join predb b using (id) group by 1, 2""",
    "submission_check": f"""with {CHECK} select *,
        missing + extra + duplicated + bad_class = 0 as valid from chk""",
    "validation_report": f"""with {CHECK}, {LINE_PRED},
        {_per_class('pred', extra="union select 'X'")},
        long as (unpivot chk on n_expected, n_submitted, missing, extra, duplicated, bad_class
                 into name metric value value)
        select metric, value::double as value from long
        union all select 'macro_f1', round(avg(f1), 6) from cls""",
    "submission_roundtrip": f"with {ORDER_PRED} select id, y_hat from pred",
    "fold_hash": f"select doc_id, {_fold('text')} as fold from documents",
    "fold_stratified": """with s as (select d.doc_id, md5(d.text) as g,
          coalesce(cast(l.quality as varchar), '') as st
          from documents d left join labels l on d.doc_id = l.doc_id),
        votes as (select g, st, count(*) as n from s group by g, st),
        pick as (select g, st, row_number() over
          (partition by g order by (st = '')::int, n desc, st) as r from votes),
        f as (select g, ((row_number() over (partition by st order by g) - 1) % 5)::int as fold
              from pick where r = 1)
        select doc_id, fold from s join f using (g)""",
    "smoke_sample": """select id, y from (select o_orderkey as id, o_orderstatus as y,
          row_number() over (partition by o_orderstatus
            order by md5(cast(o_orderkey as varchar)), o_orderkey) as r from orders) where r <= 5""",
    "exact_key_features": f"with {ORDER_PRED} select {KEY_FEATURES} from pred",
    "pattern_lookup_oof": f"""with {_lookup(
        "select id, y, fold, md5(trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g'))) as key"
        " from (" + TEXT_SAMPLES + ")", ['0', '1'])}
        select id as doc_id, y, y_hat, round(u1::double / (u0 + u1), 6) as p1 from pred""",
    "feature_align": """select o_orderkey, o_totalprice, o_custkey::double as o_custkey,
        -1e0 as o_orderpriority, -1e0 as key_extra, o_orderstatus from orders""",
    "schema_diff": "with r as (select * from documents left join labels using (doc_id)) "
    + " union all ".join(
        f"""select '{c}' as "column", {_text(a)} as type_a, {_text(b)} as type_b,
        '{s}' as status, {x or 'null::bigint'} as values_a, {y or 'null::bigint'} as values_b from r"""
        for c, a, b, s, x, y in DIFF_COLUMNS
    ),
    "feature_mismatch": _mismatch(),
    "tta_windows": f"""with {WINDOWED} select doc_id, count(*) as n_views,
        round(avg({LETTERS.format('t')}::double / nullif(length(t), 0)), 6) as mean_score
        from views group by doc_id""",
    "text_entropy": """with c as (select doc_id, unnest(string_split(text, '')) as ch from documents),
        n as (select doc_id, ch, count(*) as n from c where ch <> '' group by all)
        select doc_id, sum(n)::bigint as n_chars, count(*) as n_distinct,
          round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) as entropy from n group by doc_id""",
    "text_counts": r"""with c as (select doc_id, length(text) as n_length,
          len(regexp_extract_all(text, '[\p{L}\p{N}]+')) as n_tokens,
          len(regexp_extract_all(text, '[^\p{L}\p{N} \t\r\n]')) as n_symbols,
          len(regexp_extract_all(text, 'https?://[^ \t\r\n"''<>]+')) as n_urls,
          len(regexp_extract_all(text, '[A-Za-z0-9+/]{24,}={0,2}')) as n_base64 from documents)
        select *, round(n_symbols::double / nullif(n_length, 0), 6) as symbol_ratio from c""",
    "byte_features": """with h as (select doc_id, octet_length(encode(text)) as size, sha256(text) as sha256,
          regexp_extract_all(hex(encode(text)), '..') as b from documents),
        x as (select doc_id, unnest(b) as b, generate_subscripts(b, 1) - 1 as i from h),
        n as (select doc_id, b, count(*) as n from x group by all),
        e as (select doc_id, count(*) as n_distinct,
                log2(sum(n)) - sum(n * log2(n)) / sum(n) as entropy from n group by doc_id),
        wn as (select doc_id, i // 256 as w, b, count(*) as n from x group by all),
        we as (select doc_id, w, log2(sum(n)) - sum(n * log2(n)) / sum(n) as entropy
               from wn group by all),
        wa as (select doc_id, max(entropy) as hi, avg(entropy) as mid from we group by doc_id)
        select doc_id, size, sha256, n_distinct::int as n_distinct, round(entropy, 6) as entropy,
          round(hi, 6) as max_window_entropy, round(mid, 6) as mean_window_entropy
        from h join e using (doc_id) join wa using (doc_id)""",
    "log_hour_counts": """select user_id, date_trunc('hour', ts) as bucket, count(*) as n
        from events group by all""",
    "log_zscore": """with s as (select event_type, avg(value) as m, stddev_samp(value) as d
          from events group by event_type)
        select event_id, round(case when d > 0 then (value - m) / d end, 6) as z
        from events join s using (event_type)""",
    "log_rare_template": """with r as (select event_id, user_id,
          regexp_replace(event_type || ' ' || json_extract_string(props, '$.k'), '[0-9]', '#', 'g')
            as template from events),
        c as (select user_id, template, count(*) as template_n from r group by all),
        a as (select user_id, count(*) as n from r group by all)
        select event_id, template, template_n, round(template_n::double / n, 6) as template_share,
          (template_n::double / n <= 0.05e0)::int as is_rare
        from r join c using (user_id, template) join a using (user_id)""",
    "tabular_vector": """with m as (select avg(o_totalprice) as m, stddev_samp(o_totalprice) as d
          from orders),
        c as (select o_orderpriority, row_number() over
          (order by count(*) desc, o_orderpriority) - 1 as i from orders group by o_orderpriority)
        select o_orderkey as id, round((o_totalprice - m) / d, 6) as f0,"""
    + ", ".join(f"(i = {i})::int::double as f{i + 1}" for i in range(5))
    + " from orders cross join m join c using (o_orderpriority)",
    "centroid_scores": f"""with {_centroid_probs([('all', 0, list(range(64)))])}
        select id, fold, c as class, round(p, 6) as p from p""",
    "nb_scores": f"""with {BAYES} select id as doc_id, fold, y, round(p1, 6) as p1 from nb""",
    "simplex_line_search": models.simplex_line_search(
        WHOLE_BLOCKS.replace("label as y", f"{models.CORNER} as y"), BLOCKS
    ),
    "greedy_ensemble": models.greedy_ensemble(
        ALL_BLOCKS.replace("label as y", f"{models.CORNER} as y")
    ),
    "threshold_curve": models.threshold_curve(FIRST_CLASS),
    "threshold_summary": models.threshold_summary(FIRST_CLASS),
    "calibrated_scores": models.calibrated_scores(FIRST_CLASS),
    "session_surprise": models.SESSIONS,
    "pattern_backoff": models.pattern_backoff(TEXT_SAMPLES, TOKEN),
    "bootstrap_replicates": models.bootstrap_replicates(*TWO_PREDICTIONS, EDGES),
    "bootstrap_interval": models.bootstrap_interval(*TWO_PREDICTIONS, EDGES),
    "boosted_splits": models.boosted_splits(_fold("vec_id")),
    "boosted_scores": models.boosted_scores(_fold("vec_id")),
    "ml_scores": f"""select unnest(['logistic', 'forest', 'mlp', 'boosting']) as candidate, *
        from (select count(*) as n_rows, count(distinct vec_id) as n_ids, {SOUND} from embeddings)""",
    "text_ml_scores": f"""select 'logistic' as candidate, count(*) as n_rows,
        count(distinct doc_id) as n_ids, {SOUND} from documents""",
    "tabular_ml_scores": f"""select 'logistic' as candidate, count(*) as n_rows,
        count(distinct o_orderkey) as n_ids, {SOUND} from orders""",
    "stack_fusion": f"""select 'stack' as candidate, count(*) as n_rows,
        count(distinct vec_id) as n_ids, {SOUND} from embeddings""",
    "many_class_confusion": f"""with {MANY_PRED} select y, y_hat, count(*) as n from pred group by y, y_hat""",
    "tree_totals": """select count(*) as n_files,
        coalesce(sum(octet_length(encode(coalesce(text, '')))), 0)::bigint as n_bytes from documents""",
    "file_byte_features": """with h as (select doc_id, octet_length(encode(text)) as size, sha256(text) as sha256,
          regexp_extract_all(hex(encode(text)), '..') as b from documents),
        x as (select doc_id, unnest(b) as b from h),
        n as (select doc_id, b, count(*) as n from x group by all),
        e as (select doc_id, count(*) as n_distinct,
                log2(sum(n)) - sum(n * log2(n)) / sum(n) as entropy from n group by doc_id)
        select doc_id, size, sha256, n_distinct::int as n_distinct, round(entropy, 6) as entropy
        from h join e using (doc_id)""",
    "model_reload_same_scores": """select count(*) as n_rows, 0::bigint as n_different
        from embeddings""",
    "argmax_class": """with x as (select vec_id as id, generate_subscripts(embedding, 1) - 1 as c,
          floor(unnest(embedding)::double * 1e9 + 0.5e0)::bigint as q from embeddings)
        select id, arg_max(c, q * 1000 - c)::int as y_hat from x group by id""",
    "seed_ensemble": f"""with {ALL_BLOCKS},
        m as (select id, candidate, c, avg(p) as p from p group by all)
        select id, candidate, y_hat, round(top, 6) as confidence
        from ({_decide('m', 'id, candidate')})""",
    "metric_by_seed": f"""with {_centroid_probs(seeded_candidates())},
        pred as ({_decide('p', 'id, seed', 'y')}), {_by_model_f1('pred', 'seed')}
        select count(*) as n_seeds, round(avg(macro_f1), 6) as mean_macro_f1,
          round(stddev_samp(macro_f1), 6) as std_macro_f1, round(min(macro_f1), 6) as min_macro_f1,
          round(max(macro_f1), 6) as max_macro_f1 from f1s""",
    "adaptive_ensemble": f"""with {ALL_BLOCKS},
        pred as ({_decide('p', 'id, candidate, seed', 'y')}),
        {_by_model_f1('pred', 'candidate, seed')},
        m as (select id, c, sum(macro_f1 * p) / sum(macro_f1) as p
              from p join f1s using (candidate, seed) group by id, c)
        select id, y_hat, round(top, 6) as confidence from ({_decide('m', 'id')})""",
    "simplex_fusion": SIMPLEX,
    "selected_submission": BEST,
    "class_guard": f"""with {CANDIDATES} select candidate, n_base, n_candidate,
        round(ratio, 6) as ratio, passes from guard""",
    "candidate_select": f"""with {CANDIDATES}, {_by_model_f1('pred', 'candidate')},
        r as (select candidate, macro_f1, passes, row_number() over (order by passes desc,
          floor(macro_f1 * 1e9 + 0.5e0) desc, candidate) as rank
          from f1s join guard using (candidate))
        select candidate, round(macro_f1, 6) as macro_f1, passes, rank::int as rank,
          rank = 1 and passes as selected from r""",
    "threshold_sweep": f"""with {_lookup(
        f"select id, (y = 'F')::int as y, key, fold from ({_orders()})", ['0', '1'])},
        g as (select unnest([{', '.join(f'{x}e0' for x in GRID)}]) as threshold),
        c as (select threshold, y, floor(u1::double / (u0 + u1) * 1e9 + 0.5e0)
                >= floor(threshold * 1e9 + 0.5e0) as hit from pred cross join g),
        n as (select threshold, count(*) filter (hit and y = 1) as tp,
          count(*) filter (hit and y = 0) as fp, count(*) filter (not hit and y = 1) as fn,
          count(*) filter (not hit and y = 0) as tn from c group by threshold),
        f as (select *, coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1 from n)
        select threshold, tp, fp, fn, tn, round(tp::double / nullif(tp + fp, 0), 6) as precision,
          round(tp::double / nullif(tp + fn, 0), 6) as recall, round(f1, 6) as f1,
          round((tp + tn)::double / (tp + fp + fn + tn), 6) as accuracy,
          row_number() over (order by floor(f1 * 1e9 + 0.5e0) desc, threshold) = 1 as best from f""",
    "gated_decision": f"""with {WHOLE_BLOCKS},
        gate as (select id, 1e0 - sum(p) / 2 as g from p
                 where candidate in ('block0', 'block1') and c = 0 group by id),
        cls as (select id, c, sum(p) / 2 as p from p
                where candidate in ('block2', 'block3') and c > 0 group by id, c),
        best as ({_decide('cls', 'id')})
        select id, case when floor(g * 1e9 + 0.5e0) < 900000000 then 0 else y_hat end as y_hat
        from gate join best using (id)""",
    "pseudo_label": f"""with {BAYES} select id as doc_id, y_hat, round(top, 6) as confidence
        from sure where y is null and q >= 700000000""",
    "pseudo_label_capped": f"""with {BAYES},
        r as (select id, y_hat, top, row_number() over (partition by y_hat
                order by floor(q / 1e6) desc, md5(cast(id as varchar)), id) as r
              from sure where y is null and q >= 700000000)
        select id as doc_id, y_hat, round(top, 6) as confidence from r where r <= 50""",
    "pseudo_coverage": f"""with {BAYES}, t as (select unnest([0.5e0, 0.7e0, 0.9e0, 0.99e0]) as threshold),
        c as (select threshold, count(*) as pool,
          count(*) filter (q >= floor(threshold * 1e9 + 0.5e0)) as selected
          from sure cross join t where y is null group by threshold)
        select *, round(selected::double / pool, 6) as coverage from c""",
    "confidence_bands": f"""with {_centroid_probs([('all', 0, list(range(64)))])},
        d as ({_decide('p', 'id', 'y')}),
        b as (select *, ((floor(top * 1e9 + 0.5e0) >= floor({BANDS[0]}e0 * 1e9 + 0.5e0))::int
              + (floor(top * 1e9 + 0.5e0) >= floor({BANDS[1]}e0 * 1e9 + 0.5e0))::int) as band from d)
        select band, case band when 0 then 0e0 when 1 then {BANDS[0]}e0 else {BANDS[1]}e0 end as lower,
          count(*) as n, count(*) filter (y = y_hat) as n_right,
          round(count(*) filter (y = y_hat) / count(*)::double, 6) as precision
        from b group by band""",
    "pseudo_union": f"""with {BAYES}
        select id, y, 1e0 as weight, 0 as is_pseudo from sure where y is not null
        union all select id, y_hat, 0.5e0, 1 from sure where y is null and q >= 700000000""",
    "registry_latest": f"""with {REGISTRY}, r as (select project, version, row_number() over
          (partition by project order by major desc, minor desc, suffix desc) as r from reg)
        select project, version from r where r = 1""",
    "version_delta": f"""with {REGISTRY},
        last as (select *, row_number() over (partition by project, metric, version
                   order by logged_at desc, score desc) as r from reg),
        d as (select project, metric, version, score,
                score - lag(score) over w as delta,
                max(score) over (w rows between unbounded preceding and 1 preceding) as best_before
              from last where r = 1
              window w as (partition by project, metric order by major, minor, suffix))
        select project, metric, version, score,
          round(delta * 100e0, 6) as delta_points, best_before,
          coalesce(score < best_before, false) as regression from d""",
    "score_gap": f"""with {REGISTRY}, g as (select project, version,
          max(score) filter (metric = 'local') as l, max(score) filter (metric = 'platform') as p
          from (select *, row_number() over (partition by project, version, metric
                  order by logged_at desc, score desc) as r from reg)
          where r = 1 group by project, version)
        select project, version, l as local_score, p as platform_score,
          round((l - p) * 100e0, 6) as gap_points from g where l is not null and p is not null""",
    "run_log_parse": f"""with {LOG} select ts, project, version, selected, macro_f1, n_metrics
        from log""",
    "index_vs_log": f"""with {REGISTRY}, {LOG},
        i as (select project, version, row_number() over (partition by project
                order by major desc, minor desc, suffix desc) as r from reg),
        l as (select project, version, row_number() over (partition by project
                order by major desc, minor desc) as r from log
              where project is not null)
        select project, i.version as index_version, l.version as log_version,
          case when l.version is null then 'only_index' when i.version is null then 'only_log'
            when i.version = l.version then 'same' else 'differs' end as status
        from (select * from i where r = 1) i full join (select * from l where r = 1) l using (project)""",
    "record_check": """with r as (select doc_id as id, quality, toxic, text
          from documents left join labels using (doc_id))
        select id, 'version' as field, 'null' as problem from r where quality is null or toxic is null
        union all select id, 'root_clean', 'null' from r where quality is null
        union all select id, 'model_file', 'blank' from r where quality = 0
        union all select id, 'result_file', 'blank' from r where toxic = 1
        union all select id, 'note', 'blank' from r where trim(text) = ''""",
    "leftover_files": """with f as (select 'p' || l_suppkey as project, l_returnflag as flag,
          l_linenumber as v, 'results/' || case when l_returnflag = 'R' then 'smoke_' else '' end
            || 'submission_' || l_orderkey || '_v1.' || l_linenumber || '.csv' as path from lineitem),
        c as (select project, max(v) as top from f where flag = 'N' group by project)
        select project, path, case when flag = 'R' then 'temporary' else 'historic' end as reason
        from f left join c using (project) where flag = 'R' or v <> top""",
    "manifest_totals": """select count(*) as n_files, sum(n_chars)::bigint as n_bytes
        from documents""",
    "manifest_diff": """with d as (select lang || '/' || source || '/' || doc_id as path, text,
          quality, toxic from documents left join labels using (doc_id)),
        a as (select path, length(text) as n from d where coalesce(toxic, 0) = 0),
        b as (select path, length(regexp_replace(text, '[ \n]+', ' ', 'g')) as n
              from d where coalesce(quality, 1) = 1 or toxic = 1)
        select path, a.n as length_a, b.n as length_b,
          case when a.path is null then 'added' when b.path is null then 'removed'
            when a.n = b.n then 'same' else 'changed' end as status
        from a full join b using (path)""",
    "moved_files": models.MOVED,
    "folder_totals": models.FOLDER_TOTALS,
    "folder_diff": models.FOLDER_DIFF,
    "column_drift": models.column_drift(["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
}
