"""No streaming operator is part of the inventory: every stage is a batch over whole panels."""
