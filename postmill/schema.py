"""Tables, closed domains and wire records of the mailbox model."""

from __future__ import annotations

# Closed domains.
CATEGORIES = ("transactional", "newsletter", "social", "personal", "work", "security", "promotional", "notification", "unknown")
ACTIONS = ("archive", "trash", "add_label", "remove_label", "mark_read", "unsubscribe")
OUTCOMES = ("success", "failure", "cancelled", "skipped")
PHASES = ("initial", "incremental")
REVERSALS = ("restore_labels", "untrash")
PROVIDERS = ("gmail", "graph")

TABLES = {
    "accounts": "account_id string, provider string, email string, created_at timestamp",
    "messages": "account_id string, provider_msg_id string, thread_id string, sender string, sender_email string, subject string, snippet string, internal_date long, label_ids array<string>, history_id long, embedded_at timestamp, classified_at timestamp, category string, classified_confidence float",
    "threads": "account_id string, provider_thread_id string, last_history_id long, messages_count long",
    "labels": "account_id string, provider_label_id string, name string, label_type string",
    "sync_state": "account_id string, phase string, cursor_token string, last_history_id long, last_sync_at timestamp, initial_started_at timestamp, initial_completed_at timestamp",
    "embeddings": "account_id string, provider_msg_id string, model_version string, dim int, embedding array<float>, created_at timestamp",
    "message_clusters": "account_id string, provider_msg_id string, cluster_key string, centroid_cosine float, assigned_at timestamp",
    "cluster_classifications": "account_id string, cluster_key string, category string, confidence float, reason string, model_version string, prompt_version string, cluster_signature string, created_at timestamp",
    "staged_actions": "id long, account_id string, cluster_key string, provider_msg_id string, action_type string, payload map<string,string>, proposed_reason string, staged_at timestamp",
    "actions_log": "id long, account_id string, staged_action_id long, cluster_key string, provider_msg_id string, action_type string, outcome string, error_message string, executed_at timestamp, prior_label_ids array<string>, reversal_kind string, reversed_at timestamp",
}
MESSAGE_FIELDS = "thread_id string, sender string, sender_email string, subject string, snippet string, internal_date long, label_ids array<string>, history_id long"
#: One change: op 'delete' or 'upsert', and for the latter the message. Deletes of a page come before its upserts.
FEED = f"page long, seq long, op string, account_id string, provider_msg_id string, {MESSAGE_FIELDS}"
#: One provider page, or one message's metadata (kind gmail_message), as it was landed; pages count from 0 in each walk.
LANDED = "account_id string, kind string, page long, body string"
KINDS = ("gmail_list", "gmail_history", "graph_delta")
#: Outcomes of one execution as they come: one row for each message of a call.
JOURNAL = "staged_action_id long, chunk long, provider_msg_id string, account_id string, cluster_key string, action_type string, staged_at timestamp, outcome string, error_message string, prior_label_ids array<string>"
#: Children of messages that go with a deleted message; classifications stay, orphaned or not.
CASCADES = ("embeddings", "message_clusters")

GMAIL_LIST = "messages array<struct<id:string,threadId:string>>, nextPageToken string, resultSizeEstimate long"
GMAIL_MESSAGE = "id string, threadId string, labelIds array<string>, snippet string, internalDate string, historyId string, payload struct<headers:array<struct<name:string,value:string>>>"
_REF = "array<struct<message:struct<id:string,threadId:string>>>"
GMAIL_HISTORY = f"history array<struct<id:string,messagesAdded:{_REF},messagesDeleted:{_REF},labelsAdded:{_REF},labelsRemoved:{_REF}>>, nextPageToken string, historyId string"
GRAPH_MESSAGE = "id string, conversationId string, subject string, bodyPreview string, `from` struct<emailAddress:struct<name:string,address:string>>, receivedDateTime string, parentFolderId string, isRead boolean, categories array<string>, `@removed` struct<reason:string>"
GRAPH_DELTA = "value array<struct<" + GRAPH_MESSAGE.replace("`from` struct", "`from`:struct").replace("`@removed` struct", "`@removed`:struct").replace(" string", ":string").replace(" boolean", ":boolean").replace(" array", ":array") + ">>, `@odata.nextLink` string, `@odata.deltaLink` string"


class EngineError(Exception):
    """Any failure of this engine that a caller may want to tell apart."""


class ProviderError(EngineError):
    """A provider's answer that retries didn't mend."""

    def __init__(self, status: int, body: str = ""):
        super().__init__(f"http {status}")
        self.status, self.body = status, body


class DimensionError(EngineError):
    """An embedding of another length than the table's."""
