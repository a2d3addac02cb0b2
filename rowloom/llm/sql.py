"""SQL that the corpus queries must agree with, for DuckDB."""

NGRAM_JOIN = r"""
    with recursive w as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents
    ), s as (
        select distinct doc_id, array_to_string(words[i : i + least(3, len(words)) - 1], ' ') as gram
        from (select doc_id, words, unnest(range(1, len(words) - least(3, len(words)) + 2)) as i from w where len(words) > 0)
    ), n as (select w.doc_id, count(s.gram) as n_shingles from w left join s using (doc_id) group by 1), pairs as (
        select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b using (gram) where a.doc_id <> b.doc_id group by 1, 2
    ), l as (
        select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 90 * (x.n_shingles + y.n_shingles - shared)
    ), reach as (select doc_id as a, doc_id as b from n union select reach.a, l.b from reach join l on reach.b = l.a)
    select n.doc_id, n_shingles, min(reach.b) as component_id, (select count(*) from l where l.a = n.doc_id) as n_links
    from n join reach on reach.a = n.doc_id group by n.doc_id, n_shingles
    """

DECONTAMINATION = r"""
    with d as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents
    ), b as (
        select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark
    ), wanted as (
        select distinct cast(item_id as varchar) as item, size, array_to_string(words[i : i + size - 1], ' ') as gram
        from (select *, unnest(range(1, len(words) - size + 2)) as i from (select *, least(10, len(words)) as size from b where len(words) > 0))
    ), windows as (
        select doc_id, size, i, array_to_string(words[i : i + size - 1], ' ') as gram
        from (select doc_id, words, size, unnest(range(1, len(words) - size + 2)) as i from d join (select distinct size from wanted) on len(words) >= size)
    ), hit as (select doc_id, size, i, item from windows join wanted using (size, gram)), covered as (
        select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from hit) group by 1
    ), listed as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hit group by 1)
    select doc_id, len(words) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join covered using (doc_id) left join listed using (doc_id)
    """

SUBSTRING_DEDUP = r"""
    with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents), grams as (
        select doc_id, i, array_to_string(words[i : i + 34], ' ') as gram from (select doc_id, words, unnest(range(1, len(words) - 33)) as i from w where len(words) >= 35)
    ), twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by gram) as n from grams) where n > 1), gone as (
        select distinct doc_id, p from (select doc_id, unnest(range(i, i + 35)) as p from twice)
    ), placed as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as p from w), kept as (
        select doc_id, count(gone.p) as n_removed, string_agg(word, ' ' order by placed.p) filter (where gone.p is null) as text
        from placed left join gone using (doc_id, p) group by 1
    )
    select w.doc_id, len(words) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from w left join kept using (doc_id)
    """

QUALITY = r"""
    with w as (
        select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
    ), grams as (
        select doc_id, i, array_to_string(words[i : i + 4], ' ') as gram from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from w where len(words) >= 5)
    ), twice as (
        select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from grams) where n > 1
    ), covered as (
        select doc_id, count(distinct i + k) as n from twice, (select unnest(range(0, 5)) as k) group by doc_id
    ), m as (
        select w.doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
            list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
            coalesce(covered.n, 0) as n_repeat_words, length(regexp_replace(text, '\P{Lu}+', '', 'g')) as n_upper
        from w left join covered using (doc_id)
    ), l as (select *, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines from m)
    select doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper,
        cast((n_words < 10)::int + 2 * (100 * n_repeat_words > 20 * n_words)::int + 4 * (10 * n_symbols > n_words)::int + 8 * (100 * n_dup_lines > 30 * n_lines)::int
            + 16 * (2 * n_upper > word_chars)::int + 32 * (word_chars > 20 * n_words)::int + 64 * (word_chars < 2 * n_words)::int as bigint) as failed_bits,
        (failed_bits & 3) <> 0 as base_failed, failed_bits = 0 as kept
    from l
    """

PREFIX_TRIE = r"""
    with recursive placed as (
        select conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as turns
        from conversations where conv_id is not null group by 1
    ), crc as (
        select conv_id, turns, (list_reduce(flatten(list_transform(string_split(cast(conv_id as varchar), ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1])), lambda x, k:
            case when k >= 0 then xor(x, k) else xor(x >> 1, 3988292384 * (x & 1)) end, 4294967295::bigint)) as inverted from placed
    ), rebuilt as (
        select c.conv_id, list_concat(coalesce(f.turns[:xor(c.inverted, 4294967295) % 4], []), c.turns[xor(c.inverted, 4294967295) % 4 + 1:]) as turns
        from crc c left join placed f on f.conv_id = c.conv_id - c.conv_id % 20
    ), members as (
        select conv_id, unnest(range(0, len(turns) + 1)) as depth, turns from rebuilt
    ), nodes as (
        select depth, turns[:depth] as path, min(conv_id) as conv_id, count(*) as n_convs, string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where len(turns) = depth) as ends
        from members group by 1, 2
    ), children as (
        select depth - 1 as depth, path[:depth - 1] as path, count(*) as n_children from nodes where depth > 0 group by 1, 2
    ), known as (
        select n.*, coalesce(n_children, 0) as n_children, case when n.depth = 0 then 0 else (n_convs - 1) * len(regexp_extract_all(n.path[n.depth].text, '[^\x20\x09-\x0D]+')) end as saved
        from nodes n left join children c on c.depth = n.depth and c.path = n.path
    ), below as (
        select top, path[:top] as path, sum(saved) as saved_tokens, count(*) filter (where n_children = 0) as n_leaves from (select *, unnest(range(0, depth + 1)) as top from known) group by 1, 2
    )
    select k.conv_id, k.depth, p.conv_id as parent_conv_id, k.n_convs, k.n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, sha256(coalesce(k.ends, '')) as ends_sha256
    from known k join below b on b.top = k.depth and b.path = k.path left join nodes p on p.depth = k.depth - 1 and p.path = k.path[:k.depth - 1]
    """
