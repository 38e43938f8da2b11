"""The tables' schemas, as DDL, so that importing needs no session."""

from __future__ import annotations

CHUNK = (
    "id string, file_path string, doc_type string, name string, parent string, start_line int, language string, "
    "calls array<string>, called_by array<string>, raw array<string>, text string, symbol_names array<string>, "
    "repo_url string, branch string, commit_sha string, description string, collection string"
)
FILE = "path string, text string"
JOB = "repo string, seq long, branch string, changed_files array<string>, before_sha string, after_sha string"
COMMIT_STATE = "repo string, sha string, done boolean"
RESULT = (
    "id string, score double, file_path string, name string, doc_type string, language string, text string, description string, "
    "repo_url string, branch string, calls array<string>, called_by array<string>, expand_reason string, rerank_score double"
)
PUSH_ONE = "repository struct<clone_url:string>, ref string, before string, after string, commits array<struct<added:array<string>,modified:array<string>,removed:array<string>>>"
PUSH_TWO = (
    "repository struct<full_name:string,links:struct<html:struct<href:string>>>, "
    "push struct<changes:array<struct<`new`:struct<name:string,target:struct<hash:string>>,`old`:struct<target:struct<hash:string>>>>>"
)
NOTEBOOK = "cells array<struct<cell_type:string,source:string>>"
RETRIEVED = "array<struct<rank:int,file_path:string,name:string,score:double>>"
