"""DuckDB SQL that says the same as some queries of this subpackage, by other means."""

from __future__ import annotations

from placelens.llm.merkle_manifest import FAN

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32: its table by the rule that makes it, and the checksum of a list of bytes.
CRC_TABLE = "select list_transform(range(256), lambda n: list_reduce(range(8), lambda a, b: case when a & 1 = 1 then xor(3988292384, a >> 1) else a >> 1 end, n)) as t"
CRC = "xor(4294967295, list_reduce({0}, lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295))"
#: Bytes of a text whose characters are below U+0800.
BYTES = "flatten(list_transform(string_split({0}, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [(192 | (unicode(c) >> 6))::bigint, (128 | (unicode(c) & 63))::bigint] end))"


def merkle(depth: int = 5, height: int = 3) -> str:
    """Trees unrolled to ``depth`` levels a source and ``height`` above: enough for 16 ** depth rows and 16 ** height sources."""
    fields = lambda text: " || ".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    crc = CRC.format(BYTES.format("doc_id::varchar"))
    ctes = [
        f"crc as ({CRC_TABLE})",
        f"touched as (select d.*, sha256({fields('text')}) as leaf, case when {crc} % 5 = 0 then {LOWER.format('text')} else text end as other from documents d, crc)",
        f"rows as (select doc_id, source, leaf, sha256({fields('other')}) as shown from touched)",
        "l as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as p, count(*) over (partition by source) as n, dense_rank() over (order by source nulls first) - 1 as s from rows)",
        "n0 as (select s, p, n, leaf as h from l)",
        "c0 as (select s, p, n, doc_id, leaf, shown as f, '' as proof from l)",
    ]

    def level(k: int, nodes: str, climbers: str, size: str, span: int) -> None:
        """Runs, nodes and climbers of one level; a group of at most ``span`` rows is done before it."""
        ctes.append(f"r{k} as (select s, p // {FAN} as p, n, list(h order by p) as hs from {nodes} where {size} > {span} group by all)")
        ctes.append(f"n{k} as (select s, p, n, sha256(array_to_string(hs, '')) as h from r{k})")
        cut = f"array_to_string(hs[:c.p % {FAN}], ''), array_to_string(hs[c.p % {FAN} + 2:], '')"
        left, right = cut.split(", ''), ")[0] + ", '')", cut.split(", ''), ")[1]
        ctes.append(
            f"c{k} as (select c.s, c.p // {FAN} as p, c.n, doc_id, leaf{', subroot' if k > depth else ''}, case when hs is null then f else sha256({left} || f || {right}) end as f, "
            f"proof || case when hs is null then '' else {left} || {right} end as proof from {climbers} c left join r{k} r on r.s = c.s and r.p = c.p // {FAN})"
        )

    for k in range(1, depth + 1):
        level(k, f"n{k - 1}", f"c{k - 1}", "n", FAN ** (k - 1))
    done = " union all ".join(f"select s, h from n{k} where p = 0 and n <= {FAN**k}" + (f" and n > {FAN ** (k - 1)}" if k else "") for k in range(depth + 1))
    ctes.append(f"sub as ({done})")
    ctes.append("m0 as (select 0 as s, s as p, count(*) over () as n, h from sub)")
    ctes.append(f"d0 as (select 0 as s, c.s as p, (select count(*) from sub) as n, doc_id, leaf, f, proof, sub.h as subroot from c{depth} c join sub on sub.s = c.s)")
    for k in range(1, height + 1):
        level(depth + k, "m0" if k == 1 else f"n{depth + k - 1}", "d0" if k == 1 else f"c{depth + k - 1}", "n", FAN ** (k - 1))
    tops = " union all ".join(f"select h from {'m0' if not k else f'n{depth + k}'} where p = 0 and n <= {FAN**k}" + (f" and n > {FAN ** (k - 1)}" if k else "") for k in range(height + 1))
    ctes.append(f"top as ({tops})")
    return "with " + ",\n".join(ctes) + f"\nselect doc_id, leaf, subroot, h as root, sha256(proof) as proof_sha256, f as folded_root, f = h as verified from c{depth + height}, top"


SPELLING = rf"""
with recursive crc as ({CRC_TABLE}),
runs as (
  select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all({LOWER.format("text")}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) as run from documents),
summed as (
  select run, {CRC.format(BYTES.format("id || ':' || run"))} as h from runs, crc where length(run) >= 5),
words as (
  select case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, count(*) as n
  from summed group by 1 having length(word) >= 5 and count(*) >= 3),
less as (
  select word, n, k, substr(word, 1, k::int) || substr(word, k::int + 2) as rest from (select word, n, unnest(range(length(word))) as k from words)),
near as (
  select distinct a.word, b.word as other, b.n as m from less a join less b on a.rest = b.rest and a.k = b.k and a.word <> b.word
  union select a.word, w.word, w.n from less a join words w on w.word = a.rest
  union select w.word, a.word, a.n from less a join words w on w.word = a.rest),
best as (
  select word, count(*) as n_near, first(other order by m desc, other) as other, max(m) as m from near group by word),
forms as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= 2 * w.n then other end as form, case when m >= 2 * w.n then m end as form_n from words w left join best b using (word)),
links as (
  select word, form as at from forms where form is not null union all select l.word, f.form from links l join forms f on f.word = l.at where f.form is not null),
roots as (select l.word, l.at as root from links l join forms f on f.word = l.at where f.form is null)
select word, form, coalesce(root, word) as root, n, n_near, form_n from forms left join roots using (word)
"""
