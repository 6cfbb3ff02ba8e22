"""Training-data operators: token counts, URL judging, BPE, language ID, top-k, chat, decontamination, dedup, LM scores, ORC ids."""
