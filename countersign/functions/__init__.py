"""Column -> Column functions: every one stays inside JVM code generation."""
from countersign.functions.addresses import (
    attest_tag, event_tag, initiator_command, normalise_email, parse_address, resolve_sender,
    reverify_tag, sender_domain, sender_matches, valid_event_id, verify_tag,
)
from countersign.functions.hashing import (
    canonical_json, event_id_from_seed, hash_document, iso_millis, norm_hash,
    normalise_message_id, pad_seq, salt_from_seed, salted_message_id_hash, salted_sender_hash,
)
from countersign.functions.headers import (
    content_type, extract_boundary, field_in_group, header_block, is_delivery_status_report,
    parse_field_group, raw_header, split_headers_body, split_multipart, strip_address_type,
    text_of,
)
from countersign.functions.keys import extract_public_key, parse_block_height, to_pem
from countersign.functions.messages import (
    build_raw_message, new_message_id, reply_address, rfc5322_date, sanitize_subject,
    with_signature,
)
from countersign.functions.steps import (
    all_steps_complete, days_over, deps_met, eligible_steps, expand_flow, find_step,
    first_pending_step, is_active, is_complete, reference_clock, step_levels,
)
from countersign.functions.templates import render_default, stats_body
from countersign.functions.trust import (
    TRUST_LEVELS, classify_trust, meets_trust, pick_signature_to_archive, pick_signer,
    resolve_upgrade, summarise_auth, trust_rank,
)

__all__ = [name for name in dir() if not name.startswith("_")]
