"""Limits and texts of the jobs. Pass your own `Settings` to change them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Messages:
    """Texts that end up in results. `{}` takes the value named in the comment.

    Fixed values: the reasons and summaries, which must equal those users already have in
    their logs, hence the language. `ENGLISH` below is a drop-in alternative.
    """

    ok: str = "ok"
    deny_listed: str = "outil '{}' sur la liste interdite"  # tool
    not_allow_listed: str = "outil '{}' absent de l'allowlist"  # tool
    quota_reached: str = "quota de session atteint ({})"  # maximum
    traversal: str = "path traversal ('..') refuse"
    forbidden_tag: str = "acces aux donnees '{}' interdit"  # tag
    unknown_agent: str = "Aucune politique definie pour l'agent '{}'"  # agent
    injection: str = "injection suspecte (score {}): {}"  # score, rule names
    withheld: str = "[withheld: this text looks like an attempt to give the model orders]"
    no_pii: str = "aucune PII"
    pii_masked: str = "{} PII masquee(s): {}"  # total, counts by kind
    pii_part: str = "{} PII masquee(s)"  # total
    image_part: str = "{} image(s) distante(s) supprimee(s)"  # images
    link_part: str = "{} URL(s) a query string supprimee(s)"  # links
    egress: str = "sortie assainie: {}"  # parts
    not_open: str = "session terminee ou jamais ouverte"
    image_marker: str = "[image removed]"
    link_marker: str = "[link removed]"
    tool_failed: str = "outil en echec: {}"  # error
    model_failed: str = "LLM indisponible: {}"  # error
    missing_document: str = "KeyError: '{}'"  # path
    blocked_message: str = "BLOCKED: {}"  # reason
    error_message: str = "TOOL ERROR: {}"  # reason
    aborted_answer: str = "The session was aborted, because the model could not be reached."
    stopped_answer: str = "There was no answer within the allowed number of steps."
    # A default only: pass the prompt that your model really got.
    system_prompt: str = "Answer the request. Read files with the tools that are listed, no others."


ENGLISH = Messages(
    deny_listed="tool '{}' is on the deny-list",
    not_allow_listed="tool '{}' is not on the allow-list",
    quota_reached="session quota reached ({})",
    traversal="path traversal ('..') refused",
    forbidden_tag="access to '{}' data is forbidden",
    unknown_agent="no policy is defined for agent '{}'",
    injection="suspected injection (score {}): {}",
    no_pii="no PII",
    pii_masked="{} PII masked: {}",
    pii_part="{} PII masked",
    image_part="{} remote image(s) removed",
    link_part="{} URL(s) with a query string removed",
    egress="output sanitised: {}",
    not_open="the session has ended or was never opened",
    tool_failed="tool failed: {}",
    model_failed="model unavailable: {}",
)


@dataclass(frozen=True)
class Settings:
    # Fixed values of the rules.
    block_threshold: int = 2
    hidden_min: int = 3
    hidden_weight: int = 1
    encoded_weight: int = 2
    seconds_saved_per_action: int = 90
    max_steps: int = 6
    trace_limit: int = 500

    # Labels of decisions in reports; the last one replaces a `trace` in the replay view.
    labels: dict = field(
        default_factory=lambda: {
            "allow": "Allowed",
            "deny": "Refused by policy",
            "firewall": "Text withheld",
            "egress": "Answer cleaned",
            "error": "Failed",
            "trace": "Note",
        }
    )
    answer_label: str = "ANSWER"
    messages: Messages = Messages()


DEFAULT = Settings()
