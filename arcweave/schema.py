"""Fixed values and table schemas of the property graph."""

from __future__ import annotations

from pyspark.sql import types as T

#: Node types by their numeric codes.
NODE_TYPES = ("cnt", "dir", "ori", "rel", "rev", "snp")
TYPE_CODE = {t: i for i, t in enumerate(NODE_TYPES)}
#: Arcs that an ingest may produce.
LEGAL_ARCS = (
    "dir:cnt", "dir:dir", "dir:rev", "ori:snp", "rel:cnt", "rel:dir", "rel:rel", "rel:rev",
    "rev:dir", "rev:rev", "snp:cnt", "snp:dir", "snp:rel", "snp:rev",
)
#: Git modes that are kept as permissions; any other mode becomes none.
PERMISSIONS = {0o100644: "content", 0o100755: "executable", 0o120000: "symlink", 0o040000: "directory", 0o160000: "revision"}
#: Target type of a relation -> node type.
TARGET_TYPES = {"content": "cnt", "directory": "dir", "revision": "rev", "release": "rel", "snapshot": "snp", "file": "cnt", "dir": "dir", "rev": "rev"}
#: Loader names by the class of visit that they are; any other name is an error.
VISIT_CLASSES = {
    "archive": ("ftp", "tar", "tarball-directory"),
    "misc": ("content",),
    "package": ("bioconductor", "cpan", "cran", "crates", "deb", "golang", "hackage", "hex", "maven", "nixguix", "npm", "opam", "pubdev", "puppet", "pypi", "rubygems"),
    "push": ("deposit",),
    "vcs": ("bzr", "cvs", "git", "hg", "svn"),
    "vcs_checkout": ("git-checkout", "hg-checkout", "svn-export"),
}
#: Loaders of the few origins whose visits have none.
UNTYPED_ORIGINS = {
    "https://www.npmjs.com/package/polygon.io": "npm",
    "https://www.npmjs.com/package/@reactionaries/hookd": "npm",
    "https://github.com/shines001/krping": "git",
}
#: What an identifier looks like, and a full name with an address of mail (name, address, local part, domain).
SWHID_PATTERN = "^swh:1:(cnt|dir|ori|rel|rev|snp):[0-9a-fA-F]{40}$"
FULLNAME_PATTERN = r"^(.+)\s+<((.+)@(.+))>$"

LABEL = T.StructType([
    T.StructField("name", T.BinaryType()),
    T.StructField("permission", T.IntegerType()),
    T.StructField("visit_timestamp", T.LongType()),
    T.StructField("is_full_visit", T.BooleanType()),
    T.StructField("visit_type", T.StringType()),
])
LABEL_DDL = "struct<name:binary,permission:int,visit_timestamp:bigint,is_full_visit:boolean,visit_type:string>"
#: Groups of node properties, each of which a graph may lack.
PROPERTIES = {
    "contents": {"length": "bigint", "is_skipped": "boolean"},
    "persons": {"author_id": "bigint", "committer_id": "bigint"},
    "timestamps": {"author_ts": "bigint", "author_ts_offset": "smallint", "committer_ts": "bigint", "committer_ts_offset": "smallint"},
    "strings": {"message": "binary", "tag_name": "binary", "url": "string"},
}
NODE_COLUMNS = {"node_id": "bigint", "node_type": "string", "swhid": "string"} | {c: t for g in PROPERTIES.values() for c, t in g.items()}
ARC_COLUMNS = {"src": "bigint", "dst": "bigint", "src_type": "string", "dst_type": "string", "labels": f"array<{LABEL_DDL}>"}

#: The relations that an ingest reads, and the columns that it reads of them.
RELATIONS = {
    "content": "sha1_git string, length bigint",
    "skipped_content": "sha1_git string, length bigint",
    "directory": "id string",
    "directory_entry": "directory_id string, name binary, type string, target string, perms int",
    "revision": "id string, directory string, date timestamp, date_offset smallint, committer_date timestamp, committer_offset smallint, author binary, committer binary, message binary",
    "revision_history": "id string, parent_id string",
    "release": "id string, name binary, message binary, target string, target_type string, author binary, date timestamp, date_offset smallint",
    "snapshot": "id string",
    "snapshot_branch": "snapshot_id string, name binary, target string, target_type string",
    "origin": "id string, url string",
    "origin_visit_status": "origin string, date timestamp, status string, snapshot string, type string",
    "person": "fullname binary, sha256_fullname binary",
}
