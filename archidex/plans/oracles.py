"""DuckDB SQL that gives the expected rows of each registered query."""

from __future__ import annotations

from archidex.plans.registry import EXPORTED, NOW, SEARCH_TEXTS

# The document archive in SQL: files, entries, snapshots, drives, current view.
_ARCHIVE = r"""
with owners as (
  select distinct source, cast(substr(source, 4) as int) as n, 'drv_' || substr(sha256(source), 1, 12) as drive_id
  from documents
), f as (
  select cast(cast(substr(source, 4) as int) * 2 + v as bigint) as snapshot_id,
    lang || '/batch-' || cast(doc_id % 8 as varchar) || '/Doc_' || cast(doc_id as varchar)
      || case doc_id % 5 when 0 then '.TXT' when 1 then '.md' when 2 then '.html' when 3 then '.pdf' else '' end as path,
    n_chars + case when v = 2 and doc_id % 7 = 0 then 1 else 0 end as size,
    1704067200 + doc_id * 60 + case when v = 2 and doc_id % 17 = 0 then 3600 else 0 end as modified_at,
    case when doc_id % 10 = 0 then ''
      when doc_id % 10 = 1 then 'quick:' || sha256('q' || text)
      when v = 2 and doc_id % 19 = 0 then 'sha256:' || sha256(text || '!')
      else 'sha256:' || sha256(text) end as hash
  from documents cross join (values (1), (2)) as t(v)
  where not (v = 1 and doc_id % 13 = 5) and not (v = 2 and doc_id % 11 = 3 and doc_id % 13 <> 5)
), folders as (
  select distinct snapshot_id, split_part(path, '/', 1) as path from f
  union all
  select distinct snapshot_id, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) from f
), entries as (
  select snapshot_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) as parent_path,
    regexp_extract(path, '([^/]*)$', 1) as name, lower(regexp_extract(path, '[.]([^./]*)$', 1)) as extension,
    'file' as kind, size, modified_at, hash, false as hidden
  from f
  union all
  select snapshot_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1), regexp_extract(path, '([^/]*)$', 1), '',
    'directory', cast(0 as bigint), cast(1704067200 as bigint), '', false
  from folders
), counted as (
  select snapshot_id, count(*) filter (kind = 'file') as file_count, count(*) filter (kind = 'directory') as directory_count,
    cast(sum(size) as bigint) as total_bytes
  from entries group by snapshot_id
), snapshots as (
  select c.snapshot_id as id, o.drive_id, '/mnt/' || o.source as source_path, 'complete' as status, 'full' as hash_mode,
    c.file_count, c.directory_count, c.total_bytes, cast(o.n % 3 as bigint) as error_count,
    cast(1704000000 + (2 - c.snapshot_id % 2) * 86400 as bigint) as started_at,
    cast(1704000060 + (2 - c.snapshot_id % 2) * 86400 as bigint) as completed_at, '' as failure, o.n as n
  from counted c join owners o on o.n = (c.snapshot_id - 1) // 2
  union all
  select cast(1000000 + n as bigint), drive_id, '/mnt/' || source, case when n % 4 = 0 then 'failed' else 'scanning' end,
    'full', 0, 0, 0, 0, 1704259200, case when n % 4 = 0 then 1704259260 end,
    case when n % 4 = 0 then 'device unplugged' else '' end, n
  from owners where n % 4 < 2
), drives as (
  select o.drive_id as id, case when o.n % 2 = 0 then 'Archive ' else 'archive ' end || o.source as name,
    '/mnt/' || o.source as source_path, 'Shelf ' || cast(o.n % 3 as varchar) as location, '' as notes,
    'text|' || case when o.n % 2 = 0 then 'even' else 'odd' end as tags, '' as fingerprint,
    (select max(s.id) from snapshots s where s.drive_id = o.drive_id and s.status = 'complete') as latest_snapshot_id,
    cast(1704000000 as bigint) as created_at, cast(1704172860 as bigint) as updated_at, o.n as n
  from owners o
), current as (
  select e.*, d.id as drive_id, d.name as drive_name, d.location from entries e join drives d on d.latest_snapshot_id = e.snapshot_id
)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _key(column: str) -> str:
    return f"translate({column}, '{_UPPER}', '{_LOWER}')"


_DRIVE = "id, name, source_path, location, notes, tags, fingerprint, latest_snapshot_id, created_at, updated_at"
_SNAPSHOT = (
    "id, drive_id, source_path, status, hash_mode, file_count, directory_count, total_bytes, error_count, "
    "started_at, completed_at, failure"
)
_ENTRY = "snapshot_id, path, parent_path, name, extension, kind, size, modified_at, hash, hidden"

_OVERVIEW = f"""
, overview as (
  select d.{_DRIVE.replace(', ', ', d.')}, coalesce(s.file_count, 0) as file_count,
    coalesce(s.directory_count, 0) as directory_count, coalesce(s.total_bytes, 0) as total_bytes,
    coalesce(s.completed_at, 0) as last_scanned_at
  from drives d left join snapshots s on s.id = d.latest_snapshot_id
)
"""

# Both scans of a drive in one group per path: which of them have it, and what each says.
_DIFF = r"""
, seen as (
  select o.drive_id, e.path, count(*) as scans, bool_or(e.snapshot_id % 2 = 0) as in_new,
    any_value({'kind': e.kind, 'size': e.size, 'at': e.modified_at, 'hash': e.hash}) filter (e.snapshot_id % 2 = 1) as was,
    any_value({'kind': e.kind, 'size': e.size, 'at': e.modified_at, 'hash': e.hash}) filter (e.snapshot_id % 2 = 0) as becomes
  from entries e join owners o on o.n = (e.snapshot_id - 1) // 2
  group by o.drive_id, e.path
), judged as (
  select *, split_part(was.hash, ':', 1) as old_scheme, split_part(becomes.hash, ':', 1) as new_scheme from seen
), changes as (
  select drive_id, path, case when scans = 2 then 'changed' when in_new then 'added' else 'removed' end as change,
    coalesce(becomes.kind, was.kind) as kind, was.size as old_size, becomes.size as new_size,
    was.at as old_modified, becomes.at as new_modified
  from judged
  where scans = 1 or (was.kind, was.size, was.at) <> (becomes.kind, becomes.size, becomes.at)
    or (old_scheme = new_scheme and old_scheme in ('sha256', 'quick') and was.hash <> becomes.hash)
)
"""


def _duplicates(current: str, where: str, limit: int | None) -> str:
    page = "" if limit is None else f"order by cast(size as hugeint) * count(*) desc, hash, size limit {limit}"
    return f"""
, top as (
  select hash, size, count(*) as copies from {current} where kind = 'file' and hash like 'sha256:%' {where}
  group by hash, size having count(*) > 1 {page}
)
select hash, size, copies, drive_id, drive_name, path from {current} join top using (hash, size)
where kind = 'file' {where}
"""


# The spare-parts and web-pages catalog, already as tokens of (name, path).
_LIBRARY = r"""
with files as (
  select v as snapshot_id, 'web/p' || page_id || '/' || regexp_replace(regexp_replace(url, '^https?://', ''), '/+$', '') as path,
    strlen(html) as size, 'Web pages' as drive_name
  from pages cross join (values (1), (2)) as t(v) where v = 2 or page_id % 7 <> 0
  union all
  select v + 2, 'parts/' || replace(p_brand, '#', '-') || '/' || lower(p_type) || '/' || p_name || ' ' || p_partkey || '.dat',
    p_size, 'Spare parts'
  from part cross join (values (1), (2)) as t(v) where v = 2 or p_partkey % 5 <> 0
), library as (
  select snapshot_id, path, regexp_extract(path, '([^/]*)$', 1) as name, cast(size as bigint) as size, drive_name,
    'drv_' || substr(sha256(drive_name), 1, 12) as drive_id,
    [x for x in regexp_split_to_array(lower(regexp_extract(path, '([^/]*)$', 1)), '[^a-z0-9]+') if x <> ''] as name_tokens,
    [x for x in regexp_split_to_array(lower(path), '[^a-z0-9]+') if x <> ''] as path_tokens
  from files
), corpus as (
  select count(*) as documents, avg(len(name_tokens) + len(path_tokens)) as mean from library
)
"""


def _count(tokens: str, phrase: list[str]) -> str:
    """Occurrences of a prefix phrase in a token list."""
    tests = [f"{tokens}[i + {k}] = '{t}'" for k, t in enumerate(phrase[:-1])]
    tests.append(f"starts_with({tokens}[i + {len(phrase) - 1}], '{phrase[-1]}')")
    return f"len([i for i in range(1, len({tokens}) - {len(phrase) - 2}) if {' and '.join(tests)}])"


def _search(phrases: list[list[str]], limit: int | None, label: str) -> str:
    """One query over ``library`` as a select; ``label`` names its CTE-free subquery."""
    freq = ", ".join(
        f"8.0 * {_count('name_tokens', p)} + 1.0 * {_count('path_tokens', p)} as f{i}" for i, p in enumerate(phrases)
    )
    counts = ", ".join(f"count(*) filter (f{i} > 0) as n{i}" for i in range(len(phrases)))
    idf = "greatest(1e-6, ln((documents - n{i} + 0.5) / (n{i} + 0.5)))"
    score = " + ".join(
        f"{idf.format(i=i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * (len(name_tokens) + len(path_tokens)) / mean))"
        for i in range(len(phrases))
    )
    page = "" if limit is None else f"limit {limit}"
    matched = " and ".join(f"f{i} > 0" for i in range(len(phrases)))
    return f"""
select '{label}' as query, path, size, drive_id, drive_name, round(-({score}), 6) as score
from (select *, {freq} from library) hits
  cross join (select {counts} from (select {freq} from library) every) frequencies cross join corpus
where {matched} and snapshot_id % 2 = 0
order by -({score}), {_key('name')}, name, path {page}
"""


def _search_batch() -> str:
    # Hand-tokenized twins of the registered query texts; "red -" has a part without tokens.
    phrases = {
        "blue gear": [["blue"], ["gear"]],
        "small": [["small"]],
        "en example.com": [["en"], ["example", "com"]],
        '"brand-2"': [["brand", "2"]],
        "'brand-1' wid": [["brand", "1"], ["wid"]],
        "promo/hot": [["promo", "hot"]],
        "page 2 ref": [["page"], ["2"], ["ref"]],
        "absentword": [["absentword"]],
    }
    selects = [_search(phrases[t], 25, t.replace("'", "''")) for t in SEARCH_TEXTS if t in phrases]
    return _LIBRARY + "select query, path, score from (" + " union all ".join(f"({s})" for s in selects) + ") every"


# Merge inputs: source drives and snapshots as seen by the merge, target ones, digests.
_MERGE = (
    _ARCHIVE
    + r"""
, source_drives as (
  select * replace (case when n % 4 = 1 then 'ARCHIVE SRC' || cast(n + 1 as varchar) else 'Other ' || name end as name)
  from drives where n % 2 = 1 or n % 3 = 0
), source_snapshots as (
  select * replace (started_at - case when n % 12 = 0 then 864000 else 0 end as started_at,
    completed_at - case when n % 12 = 0 then 864000 else 0 end as completed_at)
  from snapshots where n % 2 = 1 or n % 3 = 0
), target_drives as (select * from drives where n % 2 = 0
), target_snapshots as (select * from snapshots where n % 2 = 0
), nodes as (
  select snapshot_id, kind, hash, sha256(
    """
    + "concat_ws(chr(0), path, parent_path, name, extension, kind, size, modified_at, hash, hidden)"
    + r""") as node
  from entries where snapshot_id in (select id from source_snapshots where status = 'complete')
), bodies as (
  select snapshot_id, count(*) as "rows", count(*) filter (kind = 'file') as files,
    count(*) filter (kind = 'directory') as directories, count(*) filter (hash like 'sha256:%') as full_hashes,
    sha256(count(*)
    """
    + "".join(f" || ':' || sum(cast(cast('0x' || substr(node, {16 * n + 1}, 16) as ubigint) as hugeint))" for n in range(4))
    + r""") as body_digest
  from nodes group by snapshot_id
), digests as (
  select s.*, b.body_digest, b."rows", b.files, b.directories, b.full_hashes, sha256(
    """
    + " || ".join(
        f"strlen(cast({c} as varchar)) || ':' || {c}"
        for c in [*(f"s.{c.strip()}" for c in _SNAPSHOT.split(",")), "b.body_digest"]
    )
    + rf""") as digest
  from source_snapshots s join bodies b on b.snapshot_id = s.id
), names as (
  select s.id, s.name as source_name, coalesce(t.name, case when k.name is null then s.name
      else s.name || ' (imported ' || right(s.id, 6) || ')' end) as target_name,
    case when t.id is null then 'added' else 'merged' end as status, t.id is null and k.name is not null as renamed
  from source_drives s left join target_drives t on t.id = s.id
    left join target_drives k on t.id is null and {_key('k.name')} = {_key('s.name')}
), mapped as (
  select *, cast((select max(id) from target_snapshots) + row_number() over (order by drive_id, id) as bigint) as target_id
  from digests
), newest as (
  select drive_id, max(completed_at) as completed_at, arg_max(target_id, (completed_at, id)) as target_id
  from mapped group by drive_id
)
"""
)

# Plan against a target that has receipts of every third source snapshot.
_PLANNED = r"""
, planned as (
  select s.id, s.drive_id, s.status, d.digest, case when s.status = 'complete' and s.id % 3 = 0 then s.id end as known_snapshot,
    case when s.status <> 'complete' then 'incomplete' when s.id % 3 <> 0 then 'import'
      when s.id % 2 = 0 then 'skip' else 'update' end as action
  from source_snapshots s left join digests d on d.id = s.id
)
"""


def _merged_entries(hash_expression: str) -> str:
    shared = "path, parent_path, name, extension, kind, size, modified_at"
    return _MERGE + f"""
select {_ENTRY} from entries where snapshot_id in (select id from target_snapshots)
union all
select m.target_id, {shared}, {hash_expression} as hash, hidden from entries e join mapped m on m.id = e.snapshot_id
"""


def _report(imported: str, updated: str, skipped: str, stripped: str, preserved: str, rows: str, merged: bool, dry: str) -> str:
    added = "max(0)" if merged else "count(*) filter (status = 'added')"
    known = "count(*)" if merged else "count(*) filter (status = 'merged')"
    renamed = "max(0)" if merged else "count(*) filter (renamed)"
    return _MERGE + f"""
select 2 as source_schema_version, cast((select {added} from names) as bigint) as drives_added,
  cast((select {known} from names) as bigint) as drives_merged, cast((select {renamed} from names) as bigint) as drives_renamed,
  cast({imported} as bigint) as snapshots_imported, cast({updated} as bigint) as snapshots_updated,
  cast({skipped} as bigint) as snapshots_skipped,
  (select count(*) from source_snapshots where status <> 'complete') as incomplete_snapshots_skipped,
  cast({rows} as bigint) as entries_imported, cast({stripped} as bigint) as full_hashes_stripped,
  cast({preserved} as bigint) as full_hashes_preserved, {dry} as dry_run
"""


_ALL_DIGESTS = "(select count(*) from digests)"
_ALL_FULL = "(select sum(full_hashes) from digests)"
_STRIP = "case when e.hash like 'sha256:%' then '' else e.hash end"

_SIZE = "(n_chars * case doc_id % 3 when 0 then 1 when 1 then 7919 else 15485863 end)"


def _bytes_text() -> str:
    steps = []
    for unit, power in (("PB", 5), ("TB", 4), ("GB", 3), ("MB", 2), ("KB", 1)):
        amount = f"cast({_SIZE} as double)" + " / 1000.0::double" * power
        steps.append(f"when {_SIZE} >= {1000 ** power} then printf('%.2f', {amount}) || ' {unit}'")
    return "case " + " ".join(steps) + f" else {_SIZE} || ' B' end"


_COMMITTED = (
    _ARCHIVE
    + f"""
, done as (
  select d.name, '/media/' || d.name as source_path,
    row_number() over (order by d.id) as snapshot_id, 'complete' as status, c.file_count, c.directory_count, c.total_bytes,
    cast(1 as bigint) as error_count, cast({NOW - 60} as bigint) as started_at, cast({NOW} as bigint) as completed_at,
    cast({NOW} as bigint) as updated_at, '' as failure, true as is_latest
  from drives d join counted c on c.snapshot_id = d.latest_snapshot_id
)
"""
)


# Files of the tree with the stage that decides them: samples of 64 KiB from both ends are the whole of a file of 128 KiB.
_STAGED = """
with files as (
  select source || '/' || lang || '/' || case when doc_id % 4 = 0 then '.doc' else 'doc' end || '-' || doc_id
    || case doc_id % 3 when 0 then '.TXT' when 1 then '.tar.gz' else '' end as path, strlen(text) as size, text
  from documents
), sampled as (
  select *, count(*) over (partition by size) as same_size,
    case when size > 131072 then hex(encode(text)[1:65536]) || hex(encode(text)[size - 65535:size]) end as samples
  from files
), placed as (
  select *, case when same_size = 1 then 'size' when size <= 131072 or count(*) over (partition by size, samples) = 1 then 'quick'
    else 'full' end as stage
  from sampled
), staged as (
  select path, size, stage,
    case when stage = 'full' or stage = 'quick' and size <= 131072 then 'sha256:' || sha256(text) end as hash,
    case stage when 'size' then 0 when 'quick' then least(size, 131072) else 131072 + size end as bytes_read
  from placed
)
"""


def _quick_hash() -> str:
    # Size as eight little-endian bytes, the first 64 KiB, and the end without overlap; via hex text.
    pairs = " || ".join(f"substr(size_hex, {15 - 2 * i}, 2)" for i in range(8))
    return f"""
with content as (
  select doc_id, hex(encode(repeat(text, 6))) as body, strlen(text) * 6 as size, printf('%016x', strlen(text) * 6) as size_hex
  from documents
)
select doc_id, 'quick:' || sha256(unhex({pairs} || substr(body, 1, 131072)
  || case when size > 65536 then substr(body, 2 * greatest(size - 65536, 65536) + 1) else '' end)) as hash
from content
"""


_ORDERS = r"""
with orders_view as (
  select distinct 'file' as kind, 'drv_' || substr(sha256('Orders'), 1, 12) as drive_id, 'Orders' as drive_name,
    'Archive/part-' || l_partkey % 4096 || '/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || cast(l_quantity as int) || '.'
      || lower(l_returnflag) as path,
    l_partkey + 100 as size, 'sha256:' || sha256(l_partkey || '-' || l_quantity) as hash
  from lineitem
)
"""

_TIME = "strftime(make_timestamp({0} * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
_PLACE = (
    "lpad(cast(4611686018427387904 - coalesce(completed_at, started_at) as varchar), 20, '0') "
    "|| lpad(cast(4611686018427387904 - id as varchar), 20, '0')"
)


def _time(column: str, known: bool = False) -> str:
    """UTC text of seconds; the unset time unless they are positive or always known."""
    text = _TIME.format(column)
    return text if known else f"case when coalesce({column}, 0) > 0 then {text} else '0001-01-01T00:00:00Z' end"


def _record_rows(source: str, section: int, place: str, drive: str, **fields: str) -> str:
    columns = ", ".join(f"cast({fields.get(name, 'null')} as varchar) as body_{name}" for name in EXPORTED)
    return f"select {drive} as drive_id, {section} as section, {place} as place, {columns} from {source}"


def _exported() -> str:
    """Every field of the three kinds of records; fields that are empty are left out of a record."""
    same = lambda names: {n: n for n in names.split()}
    drive = same("name source_path location notes fingerprint latest_snapshot_id file_count directory_count total_bytes")
    drive |= {"created_at": _time("created_at", True), "updated_at": _time("updated_at", True), "last_scanned_at": _time("last_scanned_at")}
    snapshot = same("drive_id source_path status hash_mode file_count directory_count total_bytes error_count")
    snapshot |= {"started_at": _time("started_at", True), "completed_at": _time("completed_at"), "failure": "nullif(failure, '')"}
    item = same("name snapshot_id path parent_path extension kind size hidden")
    item |= {"modified_at": _time("modified_at"), "hash": "nullif(hash, '')"}
    parts = [
        _record_rows("overview", 0, "''", "id", **drive),
        _record_rows("snapshots", 1, _PLACE, "drive_id", **snapshot),
        _record_rows("current", 2, "path", "drive_id", **item),
    ]
    return _ARCHIVE + _OVERVIEW + " union all ".join(parts)


def _document() -> str:
    """The nested document's lines: openings and endings as text, records by some of their fields."""
    none = "cast(null as varchar)"
    bare = f"{none} as body_name, {none} as body_path, {none} as body_status, {none} as body_size, {none} as body_modified_at"
    return _ARCHIVE + f"""
select 0 as part, '' as drive_id, 0 as section, '' as place, {bare},
  '{{"version":1,"exported_at":"' || {_time(f"{NOW}::bigint", True)} || '","drives":[' as edge, 0 as firsts
union all
select 1, id, 0, '', name, null, null, null, null, null, 0 from drives
union all
select 1, drive_id, 1, {_PLACE}, null, null, status, null, null, null, 1 from snapshots
union all
select 1, id, 2, '', {', '.join(['null'] * 5)}, '],"latest_entries":[', 0 from drives
union all
select 1, drive_id, 3, path, name, path, null, cast(size as varchar), {_time("modified_at")}, null, 1 from current
union all
select 1, id, 4, '', {', '.join(['null'] * 5)}, ']}}', 0 from drives
union all
select 2, '', 0, '', {', '.join(['null'] * 5)}, ']}}', 0
"""


def _framed_sql(*values: str) -> str:
    return " || ".join(f"strlen(cast({v} as varchar)) || ':' || cast({v} as varchar)" for v in values)


# Folders of the document archive: batches in languages in the root, so three levels from the lowest up.
_FOLDERS = _ARCHIVE + f"""
, nodes as (
  select snapshot_id, parent_path as path, sha256(name) as place,
    sha256({_framed_sql("name", "extension", "kind", "size", "modified_at", "hash", "hidden")}) as node
  from entries
), levels as (
  select snapshot_id, path, sha256(string_agg(node, '' order by place, node)) as level, count(*) as entries
  from nodes group by snapshot_id, path
), lowest as (
  select *, 2 as depth, sha256(level) as digest from levels where path like '%/%'
), middle as (
  select l.*, 1 as depth, sha256(l.level || below) as digest
  from levels l join (
    select snapshot_id, split_part(path, '/', 1) as path, sha256(string_agg(sha256({_framed_sql("name", "digest")}), ''
      order by sha256(name), sha256({_framed_sql("name", "digest")}))) as below
    from (select *, split_part(path, '/', 2) as name from lowest) group by snapshot_id, split_part(path, '/', 1)
  ) using (snapshot_id, path)
), top as (
  select l.*, 0 as depth, sha256(l.level || below) as digest
  from levels l join (
    select snapshot_id, '' as path, sha256(string_agg(sha256({_framed_sql("path", "digest")}), ''
      order by sha256(path), sha256({_framed_sql("path", "digest")}))) as below
    from middle group by snapshot_id
  ) using (snapshot_id, path)
)
select snapshot_id, path, depth, level, entries, digest from lowest
union all select snapshot_id, path, depth, level, entries, digest from middle
union all select snapshot_id, path, depth, level, entries, digest from top
"""


ORACLES: dict[str, str] = {
    "read_efu": r"""
select source || '/' || lang || '/Doc, "' || doc_id || '".TXT' as path, source || '/' || lang as parent_path,
  'Doc, "' || doc_id || '".TXT' as name, 'txt' as extension, 'file' as kind,
  cast(case when doc_id % 9 = 1 then 0 when doc_id % 9 = 2 then 9223372036854775807 else n_chars end as bigint) as size,
  cast(case when doc_id % 7 = 0 then 0
    else 1704067200 + doc_id * 60 + case when doc_id % 6 = 2 then -7200 else 0 end end as bigint) as modified_at,
  '' as hash, false as hidden
from documents
union all
select distinct source || '/' || lang, source, lang, '', 'directory', cast(0 as bigint), cast(0 as bigint), '', false from documents
""",
    "read_catalog": _ARCHIVE + f"select {_ENTRY} from entries",
    "file_inventory": r"""
with files as (
  select source || '/' || lang as parent_path, case when doc_id % 4 = 0 then '.doc' else 'doc' end || '-' || doc_id
    || case doc_id % 3 when 0 then '.TXT' when 1 then '.tar.gz' else '' end as name, doc_id, text
  from documents
)
select parent_path || '/' || name as path, parent_path, name,
  case when doc_id % 3 = 0 then 'txt' when doc_id % 3 = 1 then 'gz' when doc_id % 4 = 0 then 'doc-' || doc_id else '' end as extension,
  'file' as kind, strlen(text) as size, 'sha256:' || sha256(text) as hash, doc_id % 4 = 0 as hidden
from files
union all
select distinct source || '/' || lang, source, lang, '', 'directory', cast(0 as bigint), '', false from documents
union all
select distinct source, '', source, '', 'directory', cast(0 as bigint), '', false from documents
""",
    "staged_fingerprints": _STAGED + "select * from staged",
    "staged_duplicates": """
select 'sha256:' || sha256(text) as hash, strlen(text) as size, count(*) over (partition by text) as copies,
  source || '/' || lang || '/' || case when doc_id % 4 = 0 then '.doc' else 'doc' end || '-' || doc_id
    || case doc_id % 3 when 0 then '.TXT' when 1 then '.tar.gz' else '' end as path
from documents
qualify copies > 1
""",
    "staged_reading": _STAGED + """
select stage, count(*) as files, cast(sum(size) as bigint) as bytes, cast(sum(bytes_read) as bigint) as bytes_read,
  cast(0 as bigint) as errors
from staged group by stage
""",
    "exclude_globs": _ARCHIVE + r"""
select drive_id, path, kind from current
where not ends_with(name, '.md') and path <> 'fr' and not starts_with(path, 'fr/')
  and not regexp_matches(path, '(^|/)batch-[0-2](/|$)') and not regexp_matches(path, '^en/batch-7/Doc_[^/][.]TXT$')
""",
    "fingerprint_full": "select doc_id, 'sha256:' || sha256(text) as hash from documents",
    "fingerprint_quick": _quick_hash(),
    "export_csv": _ARCHIVE + "select drive_id, drive_name, location, path, kind, size, modified_at, hash from current",
    "export_json": _exported(),
    "export_document": _document(),
    "path_columns": r"""
with cleaned as (select page_id, regexp_replace(url, '/+$', '') as path from pages),
named as (select *, regexp_extract(path, '([^/]*)$', 1) as name from cleaned)
select page_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) as parent_path, name,
  lower(regexp_extract(name, '[.]([^.]*)$', 1)) as extension, lower(path) as name_key, starts_with(name, '.') as hidden
from named
""",
    "tag_lists": "select doc_id, lang || '|' || source as tags from documents",
    "display_text": f"""
select doc_id, {_bytes_text()} as bytes_text,
  case when {_SIZE} >= 1000000 then printf('%.1fM', cast({_SIZE} as double) / 1000000.0::double)
    when {_SIZE} >= 1000 then printf('%.1fk', cast({_SIZE} as double) / 1000.0::double) else cast({_SIZE} as varchar) end as count_text,
  case when length(text) > 12 then left(text, 11) || '…' else text end as short_text
from documents
""",
    "commit_snapshot": _COMMITTED + "select * from done",
    "fail_snapshot": _COMMITTED + f"""
select * from done
union all
select name, source_path, (select max(snapshot_id) from done) + row_number() over (order by snapshot_id), 'failed', 0, 0, 0, 0,
  {NOW}, {NOW + 5}, updated_at, 'device unplugged', false from done
""",
    "start_snapshot": _COMMITTED + f"""
select * from done
union all
select name, source_path, (select max(snapshot_id) from done) + row_number() over (order by snapshot_id), 'scanning', 0, 0, 0, 0,
  {NOW + 2}, null, updated_at, '', false from done
""",
    "commit_rejections": _ARCHIVE + f"""
select name, 'failed' as status, case n % 3 when 0 then 'listed twice' when 1 then 'unknown scan' else 'unknown kind' end as reason,
  cast(0 as bigint) as entries, cast(0 as bigint) as file_count, cast({NOW - 60} as bigint) as started_at,
  cast({NOW} as bigint) as completed_at, false as has_latest
from drives
""",
    "check_schema_version": """
select v as version, v in (1, 2) as accepted, case when v in (1, 2) then (select count(distinct source) from documents) else 0 end as drives
from (values (0), (1), (2), (3)) as t(v)
""",
    "recover_stale": _ARCHIVE + f"""
select id, drive_id, source_path, case when status = 'scanning' then 'failed' else status end as status, hash_mode, file_count,
  directory_count, total_bytes, error_count, started_at, case when status = 'scanning' then {NOW} else completed_at end as completed_at,
  case when status = 'scanning' then 'scan interrupted before completion' else failure end as failure
from snapshots
""",
    "create_drive": _ARCHIVE + f"""
select {_DRIVE} from drives
union all
select 'drv_' || substr(sha256(s_name), 1, 12), s_name, '', 'Nation ' || s_nationkey, '', 'Tape|' || s_name, '', null, {NOW}, {NOW}
from supplier
""",
    "update_drive": _ARCHIVE + f"""
select id, case when n % 4 = 1 then 'Renamed ' || name else name end as name, source_path,
  case when n % 4 = 2 then 'moved' else location end as location, notes, case when n % 4 = 3 then 'New|b' else tags end as tags,
  fingerprint, latest_snapshot_id, created_at, case when n % 4 > 0 then {NOW} else updated_at end as updated_at
from drives
""",
    "list_drives": _ARCHIVE + _OVERVIEW + "select * from overview",
    "resolve_drive": _ARCHIVE + _OVERVIEW + f"select * from overview where {_key('name')} = 'archive src3'",
    "recent_drives": _ARCHIVE + _OVERVIEW + "select id, name, last_scanned_at from overview",
    "snapshot_history": _ARCHIVE + f"select {_SNAPSHOT} from snapshots",
    "get_snapshot": _ARCHIVE + f"select {_SNAPSHOT} from snapshots where id = 4",
    "list_entries": _ARCHIVE + f"""
select {_ENTRY} from entries where snapshot_id = 4 and parent_path = 'en'
order by case kind when 'directory' then 0 else 1 end, {_key('name')}, path limit 6 offset 1
""",
    "list_latest_entries": _ARCHIVE + f"select {_ENTRY} from entries where snapshot_id = 4 and parent_path = ''",
    "snapshot_entries": _ARCHIVE + f"select {_ENTRY} from entries where snapshot_id = 3",
    "breadcrumbs": _ARCHIVE + r"""
, parts as (select drive_id, drive_name, path, string_split(path, '/') as segments from current)
select drive_id, path, 0 as depth, drive_name as label, '' as crumb_path from parts
union all
select drive_id, path, cast(i as int), segments[i], array_to_string(segments[1:i], '/')
from (select *, unnest(range(1, len(segments) + 1)) as i from parts)
""",
    "search": _LIBRARY + "select path, size, drive_id, drive_name, score from (" + _search([["blue"], ["gear"]], 100, "") + ")",
    "search_index": _LIBRARY + "select path, size, drive_id, drive_name, score from (" + _search([["blue"], ["gear"]], 100, "") + ")",
    "search_batch": _search_batch(),
    "search_topk": _LIBRARY + "select path, size, drive_id, drive_name, score from (" + _search([["brand"]], 40, "") + ")",
    "search_all": _LIBRARY + "select path, size, drive_id, drive_name, score from (" + _search([["brand"]], None, "") + ")",
    "search_index_all": _LIBRARY + "select path, size, drive_id, drive_name, score from (" + _search([["brand"]], None, "") + ")",
    "stats": _ARCHIVE + r"""
select (select count(*) from drives) as drive_count, (select count(*) from snapshots where status = 'complete') as snapshot_count,
  cast(sum(file_count) as bigint) as file_count, cast(sum(directory_count) as bigint) as directory_count,
  cast(sum(total_bytes) as bigint) as total_bytes,
  (select count(*) from current where kind = 'file' and hash <> '') as hashed_file_count
from drives d left join snapshots s on s.id = d.latest_snapshot_id
""",
    "extension_stats": _ARCHIVE + r"""
select case when extension = '' then '(none)' else extension end as extension, count(*) as count, cast(sum(size) as bigint) as bytes
from current where kind = 'file' group by current.extension order by bytes desc, 1 limit 12
""",
    "extension_stats_all": _ARCHIVE + r"""
select case when e.extension = '' then '(none)' else e.extension end as extension, count(*) as count, cast(sum(e.size) as bigint) as bytes
from current e where kind = 'file' group by e.extension
""",
    "extension_stats_drive": _ARCHIVE + r"""
select case when e.extension = '' then '(none)' else e.extension end as extension, count(*) as count, cast(sum(e.size) as bigint) as bytes
from current e where kind = 'file' and drive_name = 'Archive src4' group by e.extension order by sum(e.size) desc, e.extension limit 3
""",
    "diff": _ARCHIVE + _DIFF + f"""
select path, change, kind, old_size, new_size, old_modified, new_modified from changes
where drive_id = (select drive_id from owners where n = 1) order by {_key('path')}, path limit 1000
""",
    "diff_all": _ARCHIVE + _DIFF + """
select path, change, kind, old_size, new_size, old_modified, new_modified from changes
where drive_id = (select drive_id from owners where n = 1)
""",
    "diff_latest_two": _ARCHIVE + _DIFF + "select * from changes",
    "diff_descent": _ARCHIVE + _DIFF + """
select path, change, kind, old_size, new_size, old_modified, new_modified from changes
where drive_id = (select drive_id from owners where n = 1)
""",
    "folder_digests": _FOLDERS,
    "duplicates": _ARCHIVE + _duplicates("current", "", 50),
    "duplicates_drive": _ARCHIVE + _duplicates("current", "and drive_name = 'Archive src8'", 200),
    "duplicates_all": _ARCHIVE + _duplicates("current", "", None),
    "duplicates_orders": _ORDERS + _duplicates("orders_view", "", 200),
    "duplicates_orders_all": _ORDERS + _duplicates("orders_view", "", None),
    "duplicates_nested": _ARCHIVE + _duplicates("current", "", 50),
    "check_relationships": _ARCHIVE + r"""
, kept_snapshots as (select * from snapshots where id % 9 > 0), kept_drives as (select * from drives where n % 7 > 0)
select distinct 'entries' as child, cast(snapshot_id as varchar) as reference, 'no such snapshot' as problem
from entries where snapshot_id not in (select id from kept_snapshots)
union all
select distinct 'snapshots', drive_id, 'no such drive' from kept_snapshots where drive_id not in (select id from kept_drives)
union all
select distinct 'drives', cast(latest_snapshot_id as varchar), 'no such snapshot'
from kept_drives where latest_snapshot_id not in (select id from kept_snapshots)
""",
    "validate_drives": _ARCHIVE + r"""
select case when n % 5 = 0 then upper(id) else id end as id,
  case n % 5 when 0 then 'invalid drive id' when 1 then 'invalid name' when 2 then 'NUL metadata' else 'NUL tag' end as problem
from drives where n % 5 < 4
""",
    "validate_snapshots": _ARCHIVE + r"""
select id, case id % 6 when 0 then 'negative counts' when 1 then 'invalid timestamps' when 2 then 'invalid timestamps'
  when 3 then 'invalid hash mode' else 'NUL metadata' end as problem
from snapshots where status = 'complete' and id % 6 < 5
""",
    "validate_entries": _ARCHIVE + r"""
select snapshot_id, case k when 1 then '/' || path when 2 then path || '/' when 3 then 'a\' || path when 4 then '../' || path
    when 5 then 'x//' || path else path end as path,
  case when k <= 3 then 'invalid path' when k <= 5 then 'unsafe path' when k = 6 then 'inconsistent name' when k = 7 then 'inconsistent parent'
    when k = 8 then 'invalid metadata' when k = 9 then 'invalid fingerprint' when k = 10 then 'invalid kind' when k = 11 then 'invalid hidden flag'
    else 'negative size' end as problem
from (select *, size % 13 as k from entries) where k > 0
""",
    "reconcile_counts": _ARCHIVE + r"""
select id, file_count + 1 as file_count, file_count as files, directory_count, directory_count as directories,
  total_bytes - 1 as total_bytes, total_bytes as bytes, 'counters differ from the entries' as problem
from snapshots where status = 'complete' and id % 3 = 0
""",
    "snapshot_digest": _MERGE + 'select id, drive_id, "rows", files, directories, full_hashes, body_digest, digest from digests',
    "merge_drives": _MERGE + "select * from names",
    "plan_import": _MERGE + _PLANNED + "select * from planned",
    "remap_snapshots": _MERGE + _PLANNED + r"""
select id, drive_id, cast((select max(id) from target_snapshots) + row_number() over (order by drive_id, id) as bigint) as target_id
from planned where action = 'import'
""",
    "copy_entries": _merged_entries(_STRIP),
    "compact_catalog": _merged_entries(_STRIP),
    "apply_hash_policy": _merged_entries("e.hash"),
    "select_latest": _MERGE + r"""
select d.id, d.name, case when n.target_id is not null and n.completed_at >= s.completed_at then n.target_id
  else d.latest_snapshot_id end as latest_snapshot_id
from target_drives d join target_snapshots s on s.id = d.latest_snapshot_id left join newest n on n.drive_id = d.id
union all
select m.id, m.target_name, n.target_id from names m left join newest n on n.drive_id = m.id where m.status = 'added'
""",
    "merged_snapshots": _MERGE + f"""
select {_SNAPSHOT} from target_snapshots
union all
select target_id, drive_id, source_path, status, case when full_hashes > 0 then 'imported' else hash_mode end, file_count,
  directory_count, total_bytes, error_count, started_at, completed_at, failure from mapped
""",
    "import_receipts": _MERGE + f"""
select digest, target_id as target_snapshot_id, false as trusted_full_hashes, cast({NOW} as bigint) as imported_at from mapped
""",
    "import_report": _report(_ALL_DIGESTS, "0", "0", _ALL_FULL, "0", '(select sum("rows") from digests)', False, "false"),
    "merge_dry_run": _report("0", _ALL_DIGESTS, "0", "0", _ALL_FULL, "0", True, "true"),
}
