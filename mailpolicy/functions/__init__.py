from mailpolicy.functions import messages, names, policy, text

__all__ = ["messages", "names", "policy", "text"]
