"""Schemas of all tables as DDL, stated once and never inferred."""

from __future__ import annotations

AUTHOR = "STRUCT<name: STRING, email: STRING, timestamp: BIGINT, timezone: STRING>"
HEADERS = "ARRAY<STRUCT<name: STRING, value: STRING>>"

OBJECTS = "oid STRING, type STRING, size BIGINT, content BINARY"
TREE_ENTRIES = "tree_oid STRING, ord INT, mode STRING, name STRING, oid STRING"
COMMITS = f"oid STRING, tree STRING, parents ARRAY<STRING>, author {AUTHOR}, committer {AUTHOR}, encoding STRING, gpgsig STRING, mergetag ARRAY<STRING>, extra_headers {HEADERS}, message STRING, error STRING"
COMMIT_EDGES = "child STRING, parent STRING, ord INT"
TAGS = f"oid STRING, object STRING, object_type STRING, tag STRING, tagger {AUTHOR}, gpgsig STRING, extra_headers {HEADERS}, message STRING, error STRING"
REFS = "name STRING, target STRING"
REMOTE_REFS = "name STRING, oid STRING, peeled STRING, symref_target STRING"
SHALLOW = "oid STRING"
SNAPSHOT = "path STRING, kind STRING, mode STRING, oid STRING"
PATCH_OPS = "seq INT, op STRING, path STRING, mode STRING, oid STRING, from_path STRING, to_path STRING"
WORKTREE_OPS = "seq BIGINT, op STRING, path STRING, to_path STRING, mode STRING, oid STRING, recursive BOOLEAN"
PACK_OBJECTS = "pack STRING, offset BIGINT, type STRING, base_offset BIGINT, base_oid STRING, oid STRING, content BINARY, error STRING"
PACK_INDEX = "pack STRING, oid STRING, offset BIGINT, crc32 BIGINT"
MIDX = "oid STRING, pack_id INT, pack STRING, offset BIGINT"
REF_UPDATES = "local_ref STRING, remote_oid STRING, current_oid STRING, force BOOLEAN"
REF_LOG = "seq BIGINT, ts TIMESTAMP, name STRING, op STRING, oid STRING"

# Fixed values of the format.
OBJECT_TYPES = "commit", "tree", "blob", "tag"
PACK_TYPE_NUMBERS = {"commit": 1, "tree": 2, "blob": 3, "tag": 4, "ofs_delta": 6, "ref_delta": 7}
DIRECTORY, FILE, EXECUTABLE, SYMLINK, SUBMODULE = "040000", "100644", "100755", "120000", "160000"
ZERO_OID = "0" * 40
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
HEADS, TAGS_PREFIX, HEAD = "refs/heads/", "refs/tags/", "HEAD"
