"""Fake values: a template by category, numbered."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The fake of number n; {n} is n with three digits at least, {N} is n bare. Names are templates of our own, so reruns agree.
TEMPLATES = {
    "email": "user{n}@example.com", "hostname": "host{n}.local", "ip_address": "10.0.0.{N}", "url": "https://fake-service{n}.local", "file_path": "/fake/path{n}",
    "aws_access_key": "FAKE_AWS_KEY_{n}", "github_token": "FAKE_GITHUB_TOKEN_{n}", "gitlab_token": "FAKE_GITLAB_TOKEN_{n}", "slack_token": "FAKE_SLACK_TOKEN_{n}",
    "google_api_key": "FAKE_GOOGLE_API_KEY_{n}", "jwt": "FAKE_JWT_TOKEN_{n}", "oauth_bearer_token": "FAKE_OAUTH_TOKEN_{n}", "ssh_public_key": "ssh-rsa FAKE_SSH_KEY_{n}",
    "private_key_block": "-----BEGIN PRIVATE KEY-----\nFAKE_KEY_{n}\n-----END PRIVATE KEY-----",
    "db_connection_string": "postgres://user{n}:fake_password_{n}@host{n}.local:5432/db{n}",
    "azure_connection_string": "DefaultEndpointsProtocol=https;AccountName=fakeacct{n};AccountKey=FAKE_AZURE_KEY_{n}==",
    "generic_password_assignment": "fake_password_{n}", "generic_secret_assignment": "fake_secret_{n}", "high_entropy_string": "FAKE_SECRET_{n}", "org": "Org{n}",
    "variable": "var{n}", "function": "fn{n}", "method": "fn{n}", "class": "Cls{n}", "struct": "Struct{n}", "typedef": "Type{n}", "interface": "Iface{n}",
    "enum": "Enum{n}", "enum_member": "EnumVal{n}", "namespace": "Ns{n}", "constant": "CONST{n}",
    "person_name": "Person {n}", "username": "user_{n}",
}


def template_of(category: Column) -> Column:
    """The template of a category; of an unknown one its name, capitalised, and the number. Equal templates share their numbers."""
    known = F.create_map(*[F.lit(x) for pair in TEMPLATES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, category), F.concat(F.upper(F.substring(category, 1, 1)), F.lower(F.substring(category, 2, 2147483647)), F.lit("{n}")))


def render(template: Column, n: Column) -> Column:
    digits = n.cast("string")
    padded = F.when(n < 1000, F.lpad(digits, 3, "0")).otherwise(digits)
    return F.replace(F.replace(template, F.lit("{n}"), padded), F.lit("{N}"), digits)
