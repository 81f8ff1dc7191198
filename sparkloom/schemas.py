"""Schemas of the tables and records; never inferred."""

from __future__ import annotations

VECTOR = "array<float>"
REVIEW_COMMENTS = f"id string, github_comment_id long not null, repo_owner string, repo_name string, pr_number int, path string, line int, diff_hunk string, body string, author string, html_url string, comment_created_at timestamp_ntz, embedding {VECTOR}, created_at timestamp_ntz"
PREDICTIONS = "id string, repo_owner string, repo_name string, pr_number int, path string, predicted_line int, concern string, confidence double, source_comment_id long, matched boolean, match_type string, match_reason string, created_at timestamp_ntz"
FALSE_NEGATIVES = "id string, repo_owner string, repo_name string, pr_number int, path string, comment_line int, comment_body string, source_comment_id long, created_at timestamp_ntz"
PROCESSED_PRS = "repo_owner string, repo_name string, pr_number int, head_sha string, processed_at timestamp_ntz, status string, task_id string, lease_owner string, lease_expires_at timestamp_ntz, attempts int, dispatch_attempts int, review_payload string, last_error string, dispatched_at timestamp_ntz"
FAILED_PRS = "id string, repo_owner string, repo_name string, pr_number int, error string, attempts int, failed_at timestamp_ntz"
REPOSITORIES = "id string, github_repo_id int, name string, owner string, is_active boolean, created_at timestamp_ntz"
API_COMMENT = "id long, pull_request_url string, path string, line int, original_line int, diff_hunk string, body string, user struct<login: string>, created_at string, html_url string"
SAMPLE = "sample_id string, had_retrieval boolean, num_concerns int, best_similarity double, best_concern string, real_comment string, judge_confirmed boolean, judge_reason string"
METRIC = "threshold double, tp long, fp long, fn long, precision double, recall double, f1 double"


def struct_of(schema: str) -> str:
    """The same columns as a struct type."""
    return "struct<" + ", ".join(c.strip().replace(" ", ": ", 1) for c in schema.split(",")) + ">"


RUN_ARTIFACT = f"run_at string, split_date string, repo_pool array<array<string>>, pool_sizes_by_repo map<string, int>, tune_size int, test_size int, tuning_sweep array<{struct_of(METRIC)}>, floor_selected double, no_retrieval_match_count int, no_retrieval_match_pct double, test_sample_results array<{struct_of(SAMPLE)}>"
