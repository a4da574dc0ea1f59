"""The rules as a plain fold over one event at a time: the specification the joins must meet."""
import hashlib
import re

RANK = {"verified": 0, "forwarded": 1, "authorized": 2, "unverified": 3}


def sender_hash(sender, salt):
    return "sha256:" + hashlib.sha256(f"{salt or ''}|{sender.lower()}".encode()).hexdigest() if sender else None


def reason_for(ev, r):
    if not ev["activated_at"] or ev["activated_at"] > r["received_at"]:
        return "event_not_activated"
    if ev["archived_at"] and ev["archived_at"] <= r["received_at"]:
        return "event_archived"
    if ev["status"] == "complete":
        return "already_complete"
    sender = r["sender"]
    if r["mode"] == "crypto":
        if r["trust_level"] != "verified":
            return "unverified_trust"
        if ev["initiator"] and sender == ev["initiator"].lower():
            return "initiator_self_reply"
        if not (ev["open"] or sender in (ev["signers"] or [])):
            return "not_a_signer"
        h = sender_hash(sender, ev["salt"])
        if h and any(s["sender_hash"] == h for s in ev["signatures"]):
            return "already_signed"
        need = ev["requiredDocHash"]
        if need and all(a["sha256"] != need for a in r["attachments"]):
            return "doc_hash_mismatch"
        return None
    step = next((s for s in ev["steps"] or [] if s["id"] == r["step_id"]), None)
    if not step or not step["participant"] or sender.strip().lower() != step["participant"].strip().lower():
        return "wrong_participant"
    if step["status"] == "complete":
        return "already_complete"
    if RANK.get(r["trust_level"], 99) > RANK.get(step["minTrust"] or "verified", 99):
        return "unverified_trust"
    done = {s["id"] for s in ev["steps"] if s["status"] == "complete"}
    if any(d not in done for d in step["dependsOn"]):
        return "out_of_order" if ev["flow"] == "sequential" else "deps_unmet"
    if step["requires_attachment"] and not r["attachments"]:
        return "missing_attachment"
    return None


def apply(ev, r, seq):
    if r["mode"] == "crypto":
        ev["signatures"].append({"sender_hash": sender_hash(r["sender"], ev["salt"]) or "", "commit_sequence": seq})
        reached = len(ev["signatures"]) >= (ev["threshold"] or 1)
    else:
        for s in ev["steps"]:
            if s["id"] == r["step_id"]:
                s["status"], s["commit_sequence"] = "complete", seq
        reached = all(s["status"] == "complete" for s in ev["steps"])
    if reached and not ev["manualCompletion"]:
        ev["status"], ev["completed_at"] = "complete", r["received_at"]


def edit(ev, call):
    """Changes of one edit call, or its error."""
    if ev["status"] == "complete":
        return "EVENT_COMPLETE", []
    if ev["archived_at"] and ev["archived_at"] <= call["at"]:
        return "EVENT_ARCHIVED", []
    changes = []
    if call["title"] is not None:
        title = call["title"].strip()
        if not title:
            return "BAD_TITLE", []
        if title != ev["title"]:
            changes.append((None, "title", ev["title"], title))
    # A record without steps ignores the patch's.
    for patch in (call["steps"] or []) if ev["steps"] is not None else []:
        step = next((s for s in ev["steps"] if s["id"] == patch["id"]), None)
        if not step:
            return "STEP_NOT_FOUND", []
        if step["status"] == "complete":
            return "EVENT_STEP_FROZEN", []
        for field in ("participant", "deadline", "requires_attachment", "details"):
            if field not in patch["fields"]:
                continue
            value = patch[field]
            if field == "participant":
                value = (value or "").strip()
                if not re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", value):
                    return "BAD_EMAIL", []
            elif field == "requires_attachment":
                value = bool(value)
            else:
                value = (value or "").strip() or None
            if step[field] != value:
                changes.append((patch["id"], field, step[field], value))
    return None, changes


def replay(ev, replies, calls):
    """Entries of one event: (sequence, kind, mail_id, counted, reason); `ev` ends in its final state."""
    marks = [(c["at"], 0, c["action_id"], c) for c in calls] + [(r["received_at"], 1, str(r["mail_id"]), r) for r in replies]
    first = [c["at"] for c in calls if c["action"] == "activate"]
    if first and not ev["activated_at"]:
        ev["activated_at"] = min(first)
    entries, seq = [], 0
    for at, late, _, item in sorted(marks, key=lambda m: m[:3]):
        live = ev["activated_at"] and ev["activated_at"] <= at
        if late:
            seq += 1
            why = reason_for(ev, item)
            entries.append((seq, "reply", item["mail_id"], why is None, why))
            if why is None:
                apply(ev, item, seq)
        elif item["action"] == "edit":
            error, changes = edit(ev, item)
            for step_id, field, _, new in changes:
                if field == "title":
                    ev["title"] = new
                else:
                    next(s for s in ev["steps"] if s["id"] == step_id)[field] = new
            if changes and live:
                seq += 1
                entries.append((seq, "event_edit", None, None, None))
        elif item["action"] == "complete":
            if not (ev["archived_at"] and ev["archived_at"] <= at) and ev["status"] != "complete":
                ev["status"], ev["completed_at"] = "complete", item["completed_at"] or at
        elif item["action"] == "reopen":
            if not (ev["archived_at"] and ev["archived_at"] <= at) and ev["status"] == "complete":
                gone = {h for h in item["retract"] or [] if h}
                ev["signatures"] = [s for s in ev["signatures"] if s["sender_hash"] not in gone]
                ev["status"], ev["completed_at"] = "open", None
                if live:
                    seq += 1
                    entries.append((seq, "event_reopen", None, None, None))
    return entries
