"""The SQL of those pN_ queries that SQL can express on whole tables."""

_KEY = "nullif(trim(regexp_replace(lower(trim({c})), '^www\\.', '')), '')"
_SITE = _KEY.format(c="website")
_U = "('0x' || substr(md5('permanent:' || id), 1, 13))::bigint::double / 4503599627370496.0"

_TIES = f"""
        recursive v as (select distinct website, {_SITE} as site from eval_rows where {_SITE} is not null),
        e as (select distinct _annotation_id as task, {_SITE} as site from eval_rows where _annotation_id is not null and {_SITE} is not null),
        link as (select distinct a.site as x, b.site as y from e a join e b using (task)),
        reach(x, y) as (select distinct site, site from v union select r.x, l.y from reach r join link l on l.x = r.y)"""
_CHANCE = "('0x' || substr(md5('stepmill:' || {k}), 1, 13))::bigint::double / 4503599627370496.0"
#: The whole draw of problem 4, from the sums of probabilities to the floors.
_DRAW = f"""
        vals as (
            select distinct id, 'gold_idx' as field, gold_idx::varchar as category from eval_rows where id is not null
            union select distinct id, 'split', split from eval_rows where id is not null union select distinct id, 'website', website from eval_rows where id is not null),
        n as (select count(distinct id) as n from eval_rows),
        have as (select field, category, count(*) as have from vals where category is not null group by all),
        t as (
            select target_set, field, category, share_pct, sample_pct, min_rows, coalesce(have, 0) as have, n,
                least(greatest(share_pct::double * sample_pct * n / 10000, min_rows), coalesce(have, 0)) as draw,
                coalesce(have, 0) * 10000 < share_pct::bigint * sample_pct * n or coalesce(have, 0) < min_rows as unmet
            from (select distinct * from sample_targets) left join have using (field, category), n),
        sets as (
            select target_set, any_value(field) as field, any_value({_CHANCE.format(k="'start:' || target_set")}) as start,
                case when any_value(n) > sum(have) then least(1, greatest(0, round_even(any_value(sample_pct) * any_value(n) / 100, 0) - sum(draw)) / (any_value(n) - sum(have))) else 0 end as rest
            from t group by target_set),
        single as (select id, field, min(category) as category from vals group by id, field),
        laid as (
            select s.target_set, s.start, i.id, i.category, t.have, t.min_rows, {_CHANCE.format(k="i.id")} as u,
                least(1, case when t.draw is null then s.rest when t.have > 0 then t.draw / t.have else 0 end) as p
            from single i join sets s using (field) left join t on t.target_set = s.target_set and t.category = i.category),
        placed as (
            select *, coalesce(sum(p) over (partition by target_set order by category nulls first, u, id rows between unbounded preceding and 1 preceding), 0) - start as low
            from laid where p > 0),
        hits as (select *, ceil(low + p - 1e-9) > ceil(low - 1e-9) as hit from placed),
        need as (select target_set, category, any_value(least(min_rows, have)) - count(*) filter (hit) as need from hits where min_rows is not null group by all),
        ranks as (select h.*, need, row_number() over (partition by h.target_set, h.category, hit order by u, h.id) as k from hits h left join need d on d.target_set = h.target_set and d.category = h.category),
        drawn as (select target_set, id, category, not hit as topped_up from ranks where hit or k <= need)"""

ORACLE: dict[str, str] = {
    "p3_found": f"""
        with {_TIES}
        select distinct a.website as website_a, b.website as website_b
        from v a join reach r on r.x = a.site join v b on b.site = r.y where a.website < b.website
    """,
    "p3_sites": f"with {_TIES} select v.website, min(r.y) as label from v join reach r on r.x = v.site group by v.website",
    "p3_checks": """
        select 'ids' as rule, count(distinct id)::bigint as n from eval_rows union all select 'rows', count(distinct id) from eval_rows
        union all select unnest(['id in two splits', 'site in two splits', 'task in two splits']), 0
    """,
    "p4_sample": f"with {_DRAW} select target_set, id, category, topped_up from drawn",
    "p4_report": f"""
        with {_DRAW}, got as (select target_set, category, count(*) as drawn from drawn group by all), size as (select target_set, count(*) as size from drawn group by all)
        select t.target_set, t.category, share_pct as wanted_pct, have, round(draw, 3) as asked, coalesce(drawn, 0)::bigint as drawn, round(100 * coalesce(drawn, 0) / size, 3) as drawn_pct, unmet
        from t left join got g on g.target_set = t.target_set and g.category = t.category left join size s on s.target_set = t.target_set
    """,
    "p6_checks": """
        select window_name, (select count(*) from documents where text is not null and text <> '')::bigint as documents, 0::bigint as overfull, 0::bigint as torn, 0::bigint as cut_short, 0::bigint as wrong_room
        from context_windows where capacity_tokens > 0
    """,
    "p4_found": """
        with pairs as (
            select distinct id, 'gold_idx' as field, gold_idx::varchar as category from eval_rows
            union select distinct id, 'split', split from eval_rows union select distinct id, 'website', website from eval_rows),
        have as (select field, category, count(*) as a from pairs where category is not null and id is not null group by all),
        n as (select count(distinct id) as n from eval_rows)
        select t.target_set, t.category from sample_targets t left join have using (field, category), n
        where coalesce(a, 0) * 10000 < t.share_pct::bigint * t.sample_pct * n.n or coalesce(a, 0) < t.min_rows
    """,
    "p5_sample": f"""
        select id, {_U} as u, min(coalesce(load_no, 0))::int as first_load from eval_rows
        where id is not null group by id having {_U} < 0.2
    """,
    "p5_history": f"""
        with f as (select id, {_U} as u, min(coalesce(load_no, 0))::int as load_no from eval_rows where id is not null group by id),
        g as (select load_no, count(*) as new_ids, count(*) filter (u < 0.2) as new_chosen from f group by load_no)
        select load_no, new_ids, new_chosen, (sum(new_ids) over (order by load_no))::bigint as ids, (sum(new_chosen) over (order by load_no))::bigint as chosen from g
    """,
}
