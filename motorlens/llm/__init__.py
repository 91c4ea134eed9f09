"""Training-data operators: mixing, packing, media, classifiers, near-duplicates, search, token files, chats, licences."""
