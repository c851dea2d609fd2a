"""SQL of the split of packed cells: delimiters before the beginning of a value become a mark, which splits the cell."""

from __future__ import annotations

# What values of each field begin with.
_START = {"doi": r"(?:doi:\s*)?10\.[0-9]{4,9}/", "pubmed_id": "[0-9]", "crosswalk_app_ids": "[0-9]", "source_urls": "https?://"}
_SPACE = "' ' || chr(9) || chr(10) || chr(13)"
# quotes are doubled for the SQL literal
_RUN = r"""(?:["'']?(?:\s*[;,|&+]\s*|\s+/\s+|\s+and\s+|\s+))+"""
_OPEN = r"""[\s"'']*"""


def _cells(table: str, key: str, field: str) -> str:
    bare = rf"regexp_replace(trim({field}, {_SPACE}), '^\[|\]$', '', 'g')"
    inner = f"regexp_replace({bare}, '^(?:{_RUN})|(?:{_RUN})$', '', 'g')"
    marked = rf"regexp_replace({inner}, '{_RUN}({_OPEN}{_START[field]})', chr(1) || '\1', 'g')"
    return f"SELECT '{table}' AS table_name, {key} AS row_key, '{field}' AS field_name, string_split({marked}, chr(1)) AS parts FROM {table} WHERE trim({field}) <> ''"


P3_FOUND = f"""
WITH cells AS (
  {_cells("ukb_dmca_repositories", "repo_row_id::VARCHAR", "doi")}
  UNION ALL {_cells("ukb_dmca_repositories", "repo_row_id::VARCHAR", "pubmed_id")}
  UNION ALL {_cells("ukb_dmca_repositories", "repo_row_id::VARCHAR", "crosswalk_app_ids")}
  UNION ALL {_cells("stage3_modality_access_matrix", "modality_family", "source_urls")}
), items AS (SELECT table_name, row_key, field_name, [x FOR x IN [trim(y, {_SPACE} || '"''') FOR y IN parts] IF x <> ''] AS items FROM cells)
SELECT table_name, row_key, field_name, generate_subscripts(items, 1)::INT AS pos, unnest(items) AS item_value FROM items WHERE len(items) >= 2
"""
