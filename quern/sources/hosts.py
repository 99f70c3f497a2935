"""Answers of code and video hosts, as JSON columns, to Markdown. What is asked of the hosts, and how, is the caller's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import readers

_REPOSITORY = "description string, language string, stargazers_count long, topics array<string>, archived boolean, license struct<name:string>"
_PERSON = "user struct<login:string>"
_THREAD = f"title string, body string, state string, {_PERSON}, labels array<struct<name:string>>, comments long"
_ISSUE = f"{_THREAD}, state_reason string"
_PULL = f"{_THREAD}, merged boolean, draft boolean, base struct<ref:string>, head struct<ref:string>, additions long, deletions long, changed_files long"
_COMMENTS = f"array<struct<{_PERSON.replace(' ', ':', 1)},body:string,created_at:string>>"
_VIDEO = "title string, channel string, uploader string, upload_date string, duration double, description string"


def _or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def repository(answer: Column, readme: Column) -> Column:
    """A repository's page: its JSON description and the text of its read-me file, which may be missing."""
    r = F.from_json(answer, _REPOSITORY)
    return readers.repository_markdown(r["description"], r["language"], r["stargazers_count"], r["license"]["name"], F.coalesce(r["topics"], F.array().cast("array<string>")), F.coalesce(r["archived"], F.lit(False)), readme)


def file(owner: Column, repo: Column, path: Column, answer: Column, content: Column) -> Column:
    """A file of a repository that answer describes."""
    r = F.from_json(answer, _REPOSITORY)
    return readers.file_markdown(owner, repo, path, r["description"], r["language"], r["stargazers_count"], content)


def is_pull(answer: Column) -> Column:
    """Whether the answer about an issue is about a pull request."""
    return F.get_json_object(answer, "$.pull_request").isNotNull()


def _comments(answer: Column) -> Column:
    found = F.coalesce(F.from_json(answer, _COMMENTS), F.array().cast(_COMMENTS))
    return F.transform(found, lambda c: F.struct(_or_empty(c["user"]["login"]).alias("author"), _or_empty(c["created_at"]).alias("created_at"), _or_empty(c["body"]).alias("body")))


def _labels(thread: Column) -> Column:
    return F.transform(F.coalesce(thread["labels"], F.array().cast("array<struct<name:string>>")), lambda x: x["name"])


def issue(owner: Column, repo: Column, number: Column, answer: Column, comments: Column) -> Column:
    """An issue's thread; comments: the JSON list of its first comments."""
    i = F.from_json(answer, _ISSUE)
    state = F.when(_or_empty(i["state_reason"]) != "", F.concat(i["state"], F.lit(" ("), i["state_reason"], F.lit(")"))).otherwise(i["state"])
    return readers.thread_markdown(_or_empty(i["title"]), number, owner, repo, _or_empty(state), i["user"]["login"], F.lit(""), _labels(i), F.coalesce(i["comments"], F.lit(0)), i["body"], _comments(comments))


def pull(owner: Column, repo: Column, number: Column, answer: Column, comments: Column) -> Column:
    """A pull request's thread, with its branches and the size of its change."""
    p = F.from_json(answer, _PULL)
    count = lambda name: F.coalesce(p[name], F.lit(0)).cast("string")
    both = (_or_empty(p["base"]["ref"]) != "") & (_or_empty(p["head"]["ref"]) != "")
    branches = F.when(both, F.concat(F.lit("**Branches:** "), p["base"]["ref"], F.lit(" ← "), p["head"]["ref"], F.lit("\n"))).otherwise("")
    size = F.concat(F.lit("**Diff:** +"), count("additions"), F.lit(" −"), count("deletions"), F.lit(" across "), count("changed_files"), F.lit(" files\n"))
    state = readers.pull_state(_or_empty(p["state"]), F.coalesce(p["merged"], F.lit(False)), F.coalesce(p["draft"], F.lit(False)))
    return readers.thread_markdown(_or_empty(p["title"]), number, owner, repo, state, p["user"]["login"], F.concat(branches, size), _labels(p), F.coalesce(p["comments"], F.lit(0)), p["body"], _comments(comments))


def video(answer: Column, captions: Column) -> Column:
    """A video's page: its JSON description and the text of its caption file, which may be missing."""
    v = F.from_json(answer, _VIDEO)
    who = F.coalesce(F.when(v["channel"] != "", v["channel"]), v["uploader"])
    return readers.video_markdown(v["title"], who, _or_empty(v["upload_date"]), F.floor(F.coalesce(v["duration"], F.lit(0.0))), v["description"], readers.captions(F.coalesce(captions, F.lit(""))))


def retry_after(headers: Column) -> Column:
    """Seconds that a host asks to wait, from a map of its headers by lower-case name: retry-after, or none of its quota left; null otherwise."""
    asked = F.try_element_at(headers, F.lit("retry-after")).try_cast("long")
    left, reset = F.try_element_at(headers, F.lit("x-ratelimit-remaining")), F.try_element_at(headers, F.lit("x-ratelimit-reset")).try_cast("long")
    return F.when(asked >= 0, asked).when((left == "0") & reset.isNotNull(), F.greatest(F.lit(0), reset - F.unix_timestamp()))
