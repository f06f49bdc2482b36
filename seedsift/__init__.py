"""Find more members of a class in a huge corpus, starting from a few labelled documents."""
