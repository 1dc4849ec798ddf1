"""Schemas of the tables that the operators exchange, as DDL."""

FILES = ("path string, length bigint, content string")
CHUNKS = ("chunk_id bigint, file_path string, byte_offset bigint, line_number int, text string, token_count int")
GH_ISSUE = (
    "number bigint, title string, body string, state string, user struct<login: string>, assignees array<struct<login: string>>, labels array<struct<name: string>>, "
    "created_at string, updated_at string, html_url string, pull_request struct<html_url: string>"
)
GH_COMMENT = ("number bigint, user struct<login: string>, body string, created_at string")
SYNC_STATE = ("last_sync string, repo string, include array<string>, item_count bigint")
MANIFEST = (
    "version int, source_type string, owner string, repo string, included_kinds array<string>, synced_at string, "
    "files array<struct<number: bigint, kind: string, path: string, updated_at: string>>"
)
