"""Schemas of the nested inputs and of the stored tables."""

_NAMES = "STRUCT<nodes: ARRAY<STRUCT<name: STRING>>>"
_NAME = "STRUCT<name: STRING>"

# A repository listed below its owner.
OWNED_REPOSITORY = (
    "STRUCT<id: STRING, name: STRING, owner: STRUCT<id: STRING>, isFork: BOOLEAN, "
    "isMirror: BOOLEAN, createdAt: STRING, pushedAt: STRING, "
    f"primaryLanguage: {_NAME}, languages: {_NAMES}, defaultBranchRef: {_NAME}>"
)

# A repository found by a search, with its owner.
NODE = (
    "STRUCT<id: STRING, name: STRING, createdAt: STRING, pushedAt: STRING, "
    f"primaryLanguage: {_NAME}, languages: {_NAMES}, defaultBranchRef: {_NAME}, "
    "owner: STRUCT<id: STRING, login: STRING, "
    f"pinnedRepositories: STRUCT<nodes: ARRAY<{OWNED_REPOSITORY}>>, "
    f"repositories: STRUCT<nodes: ARRAY<{OWNED_REPOSITORY}>>>>"
)

# One page of search results.
PAGE = (
    "pageInfo STRUCT<endCursor: STRING, hasNextPage: BOOLEAN>, "
    f"nodes ARRAY<{NODE}>, _corrupt_record STRING"
)

MESSAGE = "repo_id STRING, name STRING, language STRING, message_type STRING, message STRING"

# Stored tables. Rows refer to each other by natural key; there are no surrogate numbers to
# hand out, so every task can write its rows without asking anyone.
TABLES = {
    "languages": "language STRING",
    "countries": "country STRING",
    "cities": "city STRING",
    "users": "user_id BIGINT, login STRING, full_name STRING, updated_by_user TIMESTAMP_NTZ",
    "developers": (
        "user_id BIGINT, show_email BOOLEAN, job_seeker BOOLEAN, "
        "available_for_relocation BOOLEAN, programming_experience_months SMALLINT, "
        "work_experience_months SMALLINT, description STRING, raw_location STRING, "
        "country STRING, city STRING, viewed INT"
    ),
    "contacts": "category STRING, contact STRING, user_id BIGINT",
    "technologies": "language STRING, technology STRING, synonym BOOLEAN",
    "technologies_users": "language STRING, technology STRING, user_id BIGINT",
    "technologies_users_settings": (
        "language STRING, technology STRING, user_id BIGINT, verified BOOLEAN"
    ),
    "repositories": (
        "raw_id STRING, user_id BIGINT, name STRING, lines_of_code BIGINT, "
        "updated_by_analyzer TIMESTAMP_NTZ"
    ),
    "grades": "category STRING, raw_id STRING, value DOUBLE",
}

# Rows that are kept beside the stored tables, as they come.
SIDE_TABLES = {"rejected": "kind STRING, text STRING"}
