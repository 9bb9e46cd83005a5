"""No streaming operators: every job of this library is a batch job.

The row-wise functions (``functions.text.parse_alerts``, ``operators.sequences.bucketize``,
``operators.chatlog.parse_responses``) hold no state and also accept a streaming DataFrame.
"""
